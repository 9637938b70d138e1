"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

#: Reduced texts over larger alphabets than this are sorted by doubling: inducing a bucket at a time no
#: longer pays there, and a suffix at a time takes twice as long.
SMALL_ALPHABET = 1_024


def classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S type); the last, the sentinel, is one."""
    n = len(text)
    smaller = np.ones(n, bool)
    if n > 1:
        differs = np.append(text[:-1] != text[1:], True)
        # A suffix has the type of the next place at which the character changes.
        change = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
        at = np.minimum(change, n - 2)
        smaller = (text[at] < text[at + 1]) | (change == n - 1)
    return smaller


def induce_by_bucket(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes `seeds` induce; whole buckets at a time.

    Within a bucket, suffixes that induce into the same bucket are followed in rounds, one for each
    character of a run. Every suffix is placed once from the left (L type) and once from the right (S).
    """
    k = len(sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    array = np.full(len(text), -1, np.int64)
    seeds_at = np.searchsorted(text[seeds], np.arange(k + 1))
    heads = bounds[:-1].copy()

    def place(found: np.ndarray, c: int, left: bool) -> np.ndarray:
        """Puts the suffixes into their buckets; returns those that fell into c."""
        chars = text[found]
        order = np.argsort(chars, kind="stable")
        found, chars = found[order], chars[order]
        values, first = np.unique(chars, return_index=True)
        ends = np.append(first[1:], len(found))
        same = found[:0]
        for value, a, b in zip(values.tolist(), first.tolist(), ends.tolist()):
            part = found[a:b]
            if left:
                array[heads[value] : heads[value] + b - a] = part
                heads[value] += b - a
            else:
                array[tails[value] - (b - a) : tails[value]] = part[::-1]
                tails[value] -= b - a
            if value == c:
                same = part
        return same

    def before(batch: np.ndarray, small: bool) -> np.ndarray:
        batch = batch[batch > 0] - 1
        return batch[smaller[batch] == small]

    for c in np.flatnonzero(sizes).tolist():
        batch = array[bounds[c] : heads[c]]
        while len(batch):
            batch = place(before(batch, False), c, True)
        place(before(seeds[seeds_at[c] : seeds_at[c + 1]], False), c, True)
    tails = bounds[1:].copy()
    for c in np.flatnonzero(sizes)[::-1].tolist():
        batch = array[tails[c] : bounds[c + 1]][::-1]
        while len(batch):
            batch = place(before(batch, True), c, False)
        place(before(array[bounds[c] : heads[c]][::-1], True), c, False)
    array[0] = len(text) - 1
    return array


def by_doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text over a large alphabet: ranks of twice the length in each round, sorted
    among those suffixes alone that still are equal."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def rerank(at: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Ranks the suffixes `at` (in order) by the place of the first of equals; True where equals follow."""
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[at] = base[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        return ~first | ~np.append(first[1:], True)

    places = np.arange(n)
    open_ = places[rerank(order, text[order], places)]
    step = 1
    while len(open_):
        at = order[open_]
        keys = rank[at] * (n + 1) + rank[np.minimum(at + step, n)] + 1
        sort = np.argsort(keys, kind="stable")
        order[open_] = at[sort]
        open_ = open_[rerank(at[sort], keys[sort], open_)]
        step *= 2
    return order


def same_substrings(text: np.ndarray, leftmost: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each leftmost-smaller substring in sorted `order` whether it equals the one before."""
    ends = np.append(leftmost[1:], len(text) - 1)
    length = np.zeros(len(text), np.int64)
    length[leftmost] = ends - leftmost + 1
    a, b = order[1:], order[:-1]
    same = length[a] == length[b]
    open_, at = np.flatnonzero(same), 0
    while len(open_):
        equal = text[a[open_] + at] == text[b[open_] + at]
        same[open_[~equal]] = False
        at += 1
        open_ = open_[equal]
        open_ = open_[length[a[open_]] > at]
    return np.concatenate(([False], same))


def suffix_array(text: np.ndarray, alphabet: int, apart: int | None = None) -> np.ndarray:
    """Starts of the suffixes of `text` in order. Its last element has to be 0 and the only 0.

    apart: a character that parts strings whose order beyond it is of no interest. Substrings that hold it
    then count as different, and suffixes that are equal up to it come in any order.
    """
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].astype(np.int64)
    if alphabet > SMALL_ALPHABET:
        return by_doubling(text)
    smaller = classify(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(text, minlength=alphabet)
    by_char = leftmost[np.argsort(text[leftmost], kind="stable")]
    rough = induce_by_bucket(text, smaller, by_char, sizes)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = rough[is_leftmost[rough]]
    same = same_substrings(text, leftmost, order)
    if apart is not None:
        parted = np.concatenate(([0], np.cumsum(text == apart)))
        ends = np.append(leftmost[1:], n - 1)
        holds = np.zeros(n, bool)
        holds[leftmost] = parted[ends + 1] > parted[leftmost]
        same &= ~holds[order]
    names = np.cumsum(~same) - 1
    name_at = np.empty(n, np.int64)
    name_at[order] = names
    if names[-1] + 1 < len(leftmost):
        ranked = leftmost[suffix_array(name_at[leftmost], int(names[-1]) + 1)]
    else:
        ranked = order
    return induce_by_bucket(text, smaller, ranked, sizes)


def permuted_prefixes(text: np.ndarray, array: np.ndarray, limit: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in text order, what it has in common with the suffix before it in the array:
    at most `most`, and at most the `limit` of either. Suffix i + 1 shares one less than i at least."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    most_here = np.where(before >= 0, np.minimum(np.minimum(limit, limit[before]), most), 0)
    common = np.zeros(n, np.int64)
    open_ = np.flatnonzero(most_here > 0)
    at = 0
    while len(open_):
        equal = text[open_ + at] == text[before[open_] + at]
        common[open_[equal]] = at + 1
        at += 1
        open_ = open_[equal]
        open_ = open_[most_here[open_] > at]
    return common
