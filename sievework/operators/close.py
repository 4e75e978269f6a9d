"""Close matches by the gestalt ratio: twice the characters of the longest matching blocks, by the length of both.

The longest block two texts share is taken, then the same is done with what stands before and behind it.
The blocks are a common subsequence, so the ratio is at most that of the longest one, which takes a few
operations on words of bits for one text and a whole array of others. Pairs are bounded that way, in
cells of a block of values and a chunk of targets. Values are bounded in order, so that what they start
with is bounded once for all of them, and a target that the characters left cannot bring to the cutoff is
given up for all of them; only values without enough closer matches are held against the cutoff itself.
A value's blocks are compared from the highest bound down and end where no bound reaches the last match
that is kept. No pair becomes a row before.
"""

from __future__ import annotations

import sys
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.skew import tasks
from sievework.scratch import materialize

# workers get the comparison with the plan, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values and targets of a cell, and the characters of its targets, about; the fewest values that a block is made for.
BLOCK, CHUNK, CHARS, LEAST = 32768, 1 << 19, 1 << 23, 128
#: Values that are bounded at once by few targets, and bits of a word that hold characters (one more takes the carry).
SLICE, WORD = 256, 62
#: How far above the cutoff, as a share of what is between it and 1, matches are looked for before lower ones; the last is the cutoff itself.
BARS = (0.125, 0.0)
#: Words of rows that are kept for values to come; what is not kept is worked out again.
KEPT = 1 << 24


def gestalt(a: str, b: str) -> float:
    """The ratio of two texts, 0 to 1; two empty ones are alike. Of equally long blocks the first in ``a``, then in ``b``, is taken."""
    if not a and not b:
        return 1.0
    matched, spans = 0, [(0, len(a), 0, len(b))]
    while spans:
        a0, a1, b0, b1 = spans.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        size, end_a, end_b, last = 0, 0, 0, {}
        for i in range(a0, a1):
            now = {}
            at = b.find(a[i], b0, b1)
            while at >= 0:
                now[at] = k = last.get(at - 1, 0) + 1
                if k > size:
                    size, end_a, end_b = k, i + 1, at + 1
                at = b.find(a[i], at + 1, b1)
            last = now
        if size:
            matched += size
            spans += [(a0, end_a - size, b0, end_b - size), (end_a, a1, end_b, b1)]
    return 2 * matched / (len(a) + len(b))


class Texts:
    """Texts as columns of character numbers, those of about one length together."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        found, number = np.unique(points, return_inverse=True)
        self.number = {chr(c): i + 1 for i, c in enumerate(found)}  # 0 stands behind the end
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.parts = []
        size = np.array([n.bit_length() for n in self.lengths.tolist()])
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            codes = np.zeros((len(at), self.lengths[at].max()), np.intp)
            for row, i in zip(codes, at):
                row[: self.lengths[i]] = number[starts[i] : starts[i + 1]] + 1
            self.parts.append((at, np.ascontiguousarray(codes.T)))

    def lcs(self, text: str, cutoff: float) -> np.ndarray:
        """Length of the longest subsequence that ``text`` shares with each; 0 where no length of a part is near enough for ``cutoff``.

        Rows of bits as in ``similarity.lcs_length``, a word of them for each 62 characters of ``text``.
        """
        out, n = np.zeros(len(self.texts), np.int64), len(text)
        words = range(0, n, WORD)
        masks = np.zeros((len(words), len(self.number) + 1), np.uint64)
        for i, c in enumerate(text):
            if c in self.number:
                masks[i // WORD, self.number[c]] |= np.uint64(1 << i % WORD)
        whole = [np.uint64((1 << min(WORD, n - w)) - 1) for w in words]
        for at, codes in self.parts:
            m = self.lengths[at]
            if not (2 * np.minimum(m, n) / (m + n) >= cutoff).any():
                continue
            rows = [np.full(len(at), w) for w in whole]
            hit, kept = np.empty_like(rows[0]), np.empty_like(rows[0])
            for column in codes:
                carry = None
                for row, mask, w in zip(rows, masks, whole):
                    np.take(mask, column, out=hit, mode="clip")
                    hit &= row
                    np.subtract(row, hit, out=kept)
                    row += hit
                    if carry is not None:
                        row += carry
                    if len(rows) > 1:
                        carry = row >> np.uint64(WORD)
                    row |= kept
                    if len(rows) > 1:
                        row &= w
            out[at] = n - sum(np.bitwise_count(row & w).astype(np.int64) for row, w in zip(rows, whole))
        return out


class Rows:
    """Texts of about one length as masks of bits, a row of them for each, to be met by the characters of one text after another."""

    def __init__(self, texts: list[str], at: np.ndarray):
        self.at = at
        own = [texts[i] for i in at.tolist()]
        self.lengths = np.array([len(t) for t in own], np.int64)
        longest = int(self.lengths.max())
        points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.full((len(own), longest), 0xFFFFFFFF, np.uint32)
        codes[np.arange(longest) < self.lengths[:, None]] = points
        self.codes = np.ascontiguousarray(codes.T)
        self.type = np.uint32 if longest <= 32 else np.uint64
        # one word needs no bit for a carry, which falls off its end
        self.bits = WORD if longest > 64 else self.type(0).itemsize * 8
        self.words = -(-longest // self.bits)
        self.whole = self.type((1 << self.bits) - 1)
        self.masks: dict[str, tuple[np.ndarray | None, np.ndarray] | None] = {}

    def mask(self, c: str) -> tuple[np.ndarray | None, np.ndarray] | None:
        """Where ``c`` stands in the texts: (None, all of them), or those that hold it where they are few; None where there are none."""
        if c not in self.masks:
            out = np.zeros((self.words, self.codes.shape[1]), self.type)
            for i, column in enumerate(self.codes):
                out[i // self.bits] |= (column == ord(c)).astype(self.type) << self.type(i % self.bits)
            some = np.flatnonzero(out.any(axis=0))
            self.masks[c] = None if not len(some) else (some, out[:, some]) if 4 * len(some) < out.shape[1] else (None, out)
        return self.masks[c]

    def start(self, left: np.ndarray) -> np.ndarray:
        return np.full((self.words, len(left)), self.whole, self.type)

    def step(self, rows: np.ndarray, left: np.ndarray, c: str) -> np.ndarray:
        """The rows of the texts numbered ``left`` after one more character. Bits behind a text's end stay set."""
        found = self.mask(c)
        if found is None:
            return rows
        some, mask = found
        if some is None:
            hit = mask if len(left) == mask.shape[1] else mask.take(left, axis=1)
        else:
            to = np.searchsorted(left, some)
            same = to < len(left)
            same[same] = left[to[same]] == some[same]
            hit = np.zeros_like(rows)
            hit[:, to[same]] = mask[:, same]
        hit = hit & rows
        out = rows - hit
        if self.words == 1:
            return np.bitwise_or(out, rows + hit, out=out)
        carry = self.type(0)
        for i in range(self.words):
            more = rows[i] + hit[i] + carry
            carry = more >> self.type(self.bits)
            out[i] |= more & self.whole
        return out

    def common(self, rows: np.ndarray) -> np.ndarray:
        """The characters of a longest common subsequence: the bits that are no longer set."""
        return np.bitwise_count(rows ^ self.whole).sum(axis=0, dtype=np.int64) if self.words > 1 else np.bitwise_count(rows[0] ^ self.whole)


def starts(values: list[str]) -> list[list[int]]:
    """For each of ``values``, in order and of one length, the lengths of its starts that values behind it go on from, the longest last."""
    out: list[list[int]] = [[]] * len(values)
    for i in range(len(values) - 2, -1, -1):
        x, y = values[i], values[i + 1]
        same = next(k for k, (c, d) in enumerate(zip(x, y)) if c != d)
        out[i] = [k for k in out[i + 1] if k < same] + [same]
    return out


def near(values: list[str], there: Rows, cutoff: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """value, texts of ``there`` that its longest common subsequences bring to ``cutoff``, their ratios by these; values in order and of one length."""
    n, every = len(values[0]), there.lengths
    least = np.maximum(np.floor(cutoff * (n + every) / 2).astype(np.int64) - 1, 1)
    while (short := 2 * least / (n + every) < cutoff).any():
        least += short
    left = np.flatnonzero(least <= np.minimum(n, every))
    # (characters, texts left, their rows, the least common characters), the longest start last
    stack = [(0, left, there.start(left), least[left].astype(np.int32))]
    kept, last = 0, ""
    for v, forks in zip(values, starts(values)):
        same = next((k for k, (c, d) in enumerate(zip(v, last)) if c != d), 0)
        last = v
        while stack[-1][0] > same:
            kept -= stack.pop()[2].size
        done, left, rows, least = stack[-1]
        forks = {k for k in forks if k > done}
        for i in range(done, n):
            if not len(left):
                break
            rows = there.step(rows, left, v[i])
            rest = n - i - 1
            if rest < least.max():
                keep = np.flatnonzero(there.common(rows) >= least - rest)
                if not rest or 4 * len(keep) < 3 * len(left):
                    left, rows, least = left[keep], rows[:, keep], least[keep]
            if rest and (i + 1 in forks or not len(left)) and kept + rows.size <= KEPT:
                stack.append((i + 1, left, rows, least))
                kept += rows.size
        if len(left):
            yield v, there.at[left], 2 * there.common(rows) / (n + there.lengths[left])


def closest(values: list[str], targets: list[str], cutoff: float, most: int) -> list[tuple[str, str, float]]:
    """value, target, ratio of the ``most`` closest of ``targets`` for each value; both without repeats, null and empty texts."""
    targets, best = sorted(targets), {}

    def compare(v: str, at: np.ndarray, bound: np.ndarray) -> None:
        own: list[tuple[float, int]] = best.setdefault(v, [])
        while len(at):
            top = bound.max()
            now = bound == top
            for j in at[now].tolist():
                # whatever follows has no higher bound, and of the same bound no smaller target
                if len(own) == most and (-top, j) > own[-1]:
                    break
                ratio = gestalt(v, targets[j])
                if ratio >= cutoff:
                    insort(own, (-ratio, j))
                    del own[most:]
            if len(own) == most and top <= -own[-1][0]:
                break
            at, bound = at[~now], bound[~now]

    if len(targets) < SLICE:
        lengths = np.array([len(t) for t in targets], np.int64)
        for first in range(0, len(values), SLICE):
            own = Texts(values[first : first + SLICE])
            for v, common in zip(own.texts, np.stack([own.lcs(t, cutoff) for t in targets], axis=1)):
                bound = 2 * common / (len(v) + lengths)
                at = np.flatnonzero(bound >= cutoff)
                compare(v, at, bound[at])
    else:
        lengths = np.array([len(t) for t in targets], np.int64)
        size = np.array([(-(-n // 32)).bit_length() for n in lengths.tolist()])
        parts = [Rows(targets, np.flatnonzero(size == k)) for k in np.unique(size)]
        groups: dict[int, list[str]] = {}
        for v in sorted(values):
            groups.setdefault(len(v), []).append(v)
        for share in BARS:
            bar = cutoff + (1 - cutoff) * share
            for n, own in groups.items():
                for v in own:
                    best[v] = []
                for there in parts:
                    for found in near(own, there, bar) if own else ():
                        compare(*found)
                # whatever a lower bar lets in is not as close as ``bar``
                groups[n] = [v for v in own if len(best[v]) < most or -best[v][-1][0] < bar]
    return [(v, targets[j], -r) for v, own in best.items() for r, j in own]


def close_matches(values: DataFrame, targets: DataFrame, cutoff: float = 0.85, most: int = 1) -> DataFrame:
    """value, target, ratio, place: the ``most`` closest targets of each distinct value with a ratio of ``cutoff`` or more.

    Both are tables whose first column counts; null and empty texts match nothing. Ties go to the
    smaller target. Equal texts are each other's matches with ratio 1. ``cutoff`` is above 0, at most 1.
    A cell holds about ``BLOCK`` values and ``CHUNK`` targets, whatever the size of the tables. Values of a
    block start alike where they can; how many pairs are bounded to the end depends on that and on the
    cutoff, and is at most the product of both tables.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("a cutoff is above 0 and at most 1")

    def distinct(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col(f"`{df.columns[0]}`").cast("string").alias(name)).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
        return materialize(own, "close-texts")

    a, b = distinct(values, "value"), distinct(targets, "target")
    n, (m, chars) = a.count(), b.agg(F.count("*"), F.sum(F.length("target"))).first()
    chunks = max(-(-m // CHUNK), -(-(chars or 0) // CHARS), 1)
    # each block reads its chunk's targets, so few values are not worth a block of their own beside many targets
    least = max(LEAST, m // chunks // 16)
    blocks = max(-(-n // BLOCK), min(-(-4 * tasks(a) // chunks), -(-n // least)), 1)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = a.repartitionByRange(blocks, F.length("value"), "value").select("value", F.spark_partition_id().alias("block"))
    a = a.select("value", "block", every(chunks).alias("chunk"))
    b = b.select("target", every(blocks).alias("block"), F.pmod(F.xxhash64("target"), F.lit(chunks)).cast("int").alias("chunk"))

    def compared(v: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found = closest(v["value"].tolist(), t["target"].tolist(), cutoff, most) if len(v) and len(t) else []
        return pd.DataFrame(found, columns=["value", "target", "ratio"])

    # the number is given: texts are few bytes, and adaptive execution would put all cells into one task; few cells should share one
    x, y = (df.repartition(min(4 * blocks * chunks, 2000), "block", "chunk").groupBy("block", "chunk") for df in (a, b))
    found = x.cogroup(y).applyInPandas(compared, "value string, target string, ratio double")
    place = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("ratio"), "target"))
    return found.withColumn("place", place).where(F.col("place") <= most)
