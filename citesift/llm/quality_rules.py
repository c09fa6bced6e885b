"""Quality rules, the chief one on repetition found with suffix arrays over words.

The suffixes of a text's words are sorted by prefix doubling. Neighbours in that
order give the longest common prefixes, whose intervals are the repeated
substrings; an interval is a maximal repeat if its occurrences also differ in the
word before them. The spans of all maximal repeats of ``MIN_REPEAT`` words and more
are united: the share of words they cover and the longest repeat are limited.

Texts are worked on in chunks of about ``CHUNK`` words with the number of the text
as part of each symbol, so that one sort serves many texts and no suffix is
compared with those of another. After the first rounds only suffixes that still
share a prefix are sorted on, and intervals are only listed where a repeat is long
enough. One text is never split; memory is a small multiple of the longest one.

A null text has no words, like an empty one, and fails the rules with 0 words.
Repeated rows and null ids are measured like any other row, ids are not looked at,
other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed by the contract: what separates words, what counts as a symbol, the base rule.
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50

# Words a repeat must have to count; limits on the covered percentage and the longest repeat.
MIN_REPEAT = 10
MOST_COVERED_PERCENT = 20
LONGEST_REPEAT = 50
CHUNK = 500_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(
            T.StructField(name, T.LongType())
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats")
        ),
        T.StructField("longest_repeat", T.LongType()),
        T.StructField("n_covered", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


@dataclass
class Suffixes:
    """Suffix order of several texts laid end to end.

    ``order[slot]`` is the suffix at a slot; ``levels[l]`` ranks suffixes by their
    first ``2 ** l`` words, equal numbers for equal words; ``lcp[slot]`` is the common
    prefix with the slot before, exact where it has at least ``least`` words and 0 else.
    """

    order: np.ndarray
    levels: list[np.ndarray]
    lcp: np.ndarray


def suffixes(symbols: np.ndarray, ends: np.ndarray, least: int) -> Suffixes:
    """``symbols`` differ between texts; ``ends[i]`` is the end of the text that holds ``i``."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[order] = _starts(symbols[order])
    small = np.int32 if n < 2**31 else np.int64
    levels, step, slots = [ranks.astype(small)], 1, np.arange(n)
    while True:
        # Groups only ever split, so slots that are settled stay so.
        at = ranks[order[slots]]
        same = at[1:] == at[:-1]
        slots = slots[np.append(same, False) | np.append(False, same)] if n else slots
        if not len(slots):
            break
        # Slots of one group are adjacent, so sorted suffixes go back into the same slots.
        open_ = order[slots]
        after = open_ + step
        following = np.where(after < ends[open_], ranks[np.minimum(after, n - 1)], -1)
        key = ranks[open_] * (n + 1) + following + 1
        by = np.argsort(key, kind="stable")
        order[slots] = open_[by]
        ranks[open_[by]] = slots[_starts(key[by])]
        levels.append(ranks.astype(small))
        step *= 2
    return Suffixes(order, levels, _common(order, levels, ends, least))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """For sorted values, the position where the run of each begins."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))


def _common(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray, least: int) -> np.ndarray:
    """Common prefixes of neighbours, by halving steps over the ranks of each level."""
    lcp = np.zeros(len(order), np.int64)
    shared = max(least.bit_length() - 1, 0)
    if shared >= len(levels) or len(order) < 2:
        return lcp
    at = levels[shared][order]
    slots = np.flatnonzero(at[1:] == at[:-1]) + 1
    a, b = order[slots - 1], order[slots]
    found = np.zeros(len(slots), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + found, b + found
        inside = (x < ends[a]) & (y < ends[b])
        ranks = levels[level]
        last = len(ranks) - 1
        same = inside & (ranks[np.minimum(x, last)] == ranks[np.minimum(y, last)])
        found[same] += 1 << level
    lcp[slots] = np.where(found >= least, found, 0)
    return lcp


def intervals(lcp: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """``(first slot, last slot, length, parent)`` of every interval of positive common
    prefixes, outer ones before their inner ones, and the interval of each slot's value."""
    found: list[list[int]] = []
    owner = np.full(len(lcp), -1, np.int64)
    where = np.flatnonzero(lcp > 0)
    previous = -2
    stack: list[int] = []
    for slot, length in zip(where.tolist(), lcp[where].tolist()):
        if slot != previous + 1:
            for k in stack:
                found[k][1] = previous
            stack = []
        first = slot - 1
        closed = -1
        while stack and found[stack[-1]][2] > length:
            closed = stack.pop()
            found[closed][1] = slot - 1
            first = found[closed][0]
        if not stack or found[stack[-1]][2] < length:
            found.append([first, -1, length, stack[-1] if stack else -1])
            if closed >= 0:
                found[closed][3] = len(found) - 1
            stack.append(len(found) - 1)
        elif closed >= 0:
            found[closed][3] = stack[-1]
        owner[slot] = stack[-1]
        previous = slot
    for k in stack:
        found[k][1] = previous
    return [tuple(x) for x in found], owner


def maximal_repeats(symbols: np.ndarray, ends: np.ndarray, sorted_: Suffixes) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Maximal repeats as ``(first slot, last slot, length)``, and for each suffix the
    length of the longest of them that begins there (0 if none)."""
    order, lcp = sorted_.order, sorted_.lcp
    nodes, owner = intervals(lcp)
    best = np.zeros(len(order), np.int64)
    if not nodes:
        return [], best
    # The word before each suffix; texts differ in their symbols, so a text's start differs too.
    before = np.where(order > 0, symbols[np.maximum(order - 1, 0)], -1)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    first, last, length, parent = (np.array(x) for x in zip(*nodes))
    maximal = changes[last] > changes[first]
    reach = np.where(maximal, length, 0)
    # A node that is no maximal repeat passes on the length of the next one around it.
    for k in _outer_first(parent):
        if not maximal[k] and parent[k] >= 0:
            reach[k] = reach[parent[k]]
    following = np.append(lcp[1:], 0)
    mine = np.where(lcp >= following, owner, np.append(owner[1:], -1))
    inside = mine >= 0
    best[order[inside]] = reach[mine[inside]]
    return list(zip(first[maximal].tolist(), last[maximal].tolist(), length[maximal].tolist())), best


def _outer_first(parent: np.ndarray) -> list[int]:
    """Every node after its parent."""
    depth_first: list[int] = []
    children: dict[int, list[int]] = defaultdict(list)
    for k, p in enumerate(parent.tolist()):
        children[p].append(k)
    todo = list(children[-1])
    while todo:
        k = todo.pop()
        depth_first.append(k)
        todo += children[k]
    return depth_first


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions some span covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def _repeated_windows(sorted_: Suffixes, ends: np.ndarray) -> np.ndarray:
    """Words inside three-word windows that occur twice or more in their text."""
    n = len(ends)
    if len(sorted_.levels) < 2:
        return np.zeros(n, bool)
    pairs = sorted_.levels[1]
    shared = np.bincount(pairs, minlength=n)[pairs] > 1
    at = np.flatnonzero(shared & (np.arange(n) + 3 <= ends))
    at = at[shared[at + 1]]
    key = pairs[at] * (n + 1) + pairs[at + 1]
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[counts[where] > 1]
    return _covered(twice, np.full(len(twice), 3), n)


def _chunk(texts: list[str]) -> dict[str, list]:
    """The columns after ``doc_id`` for the texts of one chunk."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    split = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    stops = np.cumsum(sizes)
    n = int(stops[-1]) if len(stops) else 0
    words = np.fromiter((numbers[w] for ws in split for w in ws), np.int64, n)
    del split
    text_of = np.repeat(np.arange(len(texts)), sizes)
    symbols = text_of * (len(numbers) + 1) + words
    ends = np.repeat(stops, sizes)
    sorted_ = suffixes(symbols, ends, MIN_REPEAT)
    repeats, best = maximal_repeats(symbols, ends, sorted_)
    starts = np.flatnonzero(best)
    covered = _covered(starts, best[starts], n)
    again = _repeated_windows(sorted_, ends)

    def per_text(flags: np.ndarray) -> list[int]:
        return np.bincount(text_of[flags], minlength=len(texts)).tolist()

    longest = np.zeros(len(texts), np.int64)
    number = np.zeros(len(texts), np.int64)
    if repeats:
        first, _, length = (np.array(x) for x in zip(*repeats))
        holder = text_of[sorted_.order[first]]
        np.maximum.at(longest, holder, length)
        np.add.at(number, holder, 1)
    n_words, n_again, n_covered = sizes.tolist(), per_text(again), per_text(covered)
    # A text's start also ends a span: spans never run from one text into the next.
    begins = covered & np.concatenate([[True], ~covered[:-1] | (text_of[1:] != text_of[:-1])])[:n]
    finishes = covered & np.concatenate([~covered[1:] | (text_of[1:] != text_of[:-1]), [True]])[:n]
    spans: list[list[list[int]]] = [[] for _ in texts]
    for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(finishes).tolist()):
        k = int(text_of[a])
        offset = int(stops[k] - sizes[k])
        spans[k].append([a - offset, b - offset + 1])
    base = [w < FEWEST_WORDS or 100 * r > MOST_REPEATED_PERCENT * w for w, r in zip(n_words, n_again)]
    kept = [
        not failed and 100 * c <= MOST_COVERED_PERCENT * w and r <= LONGEST_REPEAT
        for failed, c, w, r in zip(base, n_covered, n_words, longest.tolist())
    ]
    filled = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": [len(t) - sum(map(t.count, BLANKS)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in filled],
        "n_repeat_words": n_again,
        "n_repeats": number.tolist(),
        "longest_repeat": longest.tolist(),
        "n_covered": n_covered,
        "spans": spans,
        "base_failed": base,
        "kept": kept,
    }


def measure(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``, see ``SCHEMA``: counts, repeats, verdict.

    ``n_repeats`` maximal repeats of ``MIN_REPEAT`` words and more, the longest of which has
    ``longest_repeat`` words; ``spans`` are the word spans they cover, as ``[first, end)``,
    ``n_covered`` words in all. ``kept`` is false where the base rule or a limit fails.
    """
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(f.name, pa.int64()) for f in SCHEMA.fields[1:9]]
        + [("spans", pa.list_(pa.list_(pa.int64()))), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, size = 0, 0
            for at in range(len(texts)):
                # About six bytes make a word.
                size += len(texts[at].as_py() or "") // 6
                if size >= CHUNK or at == len(texts) - 1:
                    part = _chunk([x or "" for x in texts.slice(start, at + 1 - start).to_pylist()])
                    columns = [ids.slice(start, at + 1 - start).cast(pa.int64())]
                    columns += [pa.array(part[f.name], f.type) for f in list(schema)[1:]]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    start, size = at + 1, 0

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)


def sql() -> str:
    """The registered query in SQL: a word is covered by a repeat of ``m`` words and more
    where it lies in an ``m``-word window that occurs twice in its text."""

    def repeated(name: str, size: int) -> str:
        return f"""{name} as (
  select r, s from (
    select r, s, count(*) over (partition by r, win) as n from (
      select r, s, array_to_string(ws[s:s + {size - 1}], ' ') as win
      from (select r, ws, unnest(range(1, greatest(len(ws) - {size} + 2, 1))) as s from d)))
  where n > 1)"""

    def words_in(name: str, size: int) -> str:
        return f"(select r, count(distinct p) as n from (select r, unnest(range(s, s + {size})) as p from {name}) group by r)"

    blank = r"\x20\x09-\x0D"
    return rf"""with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^{blank}]+') as ws
  from documents
),
lines as (
  select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(t, chr(10))) as line from d)
  where regexp_matches(line, '[^{blank}]') group by r
),
{repeated("three", 3)},
{repeated("many", MIN_REPEAT)},
{repeated("longer", LONGEST_REPEAT + 1)},
m as (
  select d.doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[{blank}]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(a.n, 0)::bigint as n_repeat_words,
    coalesce(b.n, 0)::bigint as n_covered, d.r in (select r from longer) as too_long
  from d left join lines using (r) left join {words_in("three", 3)} a using (r)
  left join {words_in("many", MIN_REPEAT)} b using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
  n_words < {FEWEST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words as base_failed,
  not (n_words < {FEWEST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words or too_long
       or 100 * n_covered > {MOST_COVERED_PERCENT} * n_words) as kept
from m"""
