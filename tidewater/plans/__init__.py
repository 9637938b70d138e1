"""Named queries: each module holds Spark plans beside the DuckDB SQL they are held against."""

from tidewater.plans import alerts, audit, checks, corpus, curation, features, files, languages, messages, models, risk, streams

QUERIES = {}
ORACLES = {}
for _module in (corpus, messages, languages, curation, features, audit, risk, alerts, checks, files, models, streams):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
