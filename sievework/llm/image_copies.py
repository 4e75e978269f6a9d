"""Media columns: cropped or edited copies of images by local descriptors.

* Corners: Harris responses on an image pyramid (``SCALES``), all local maxima over ``RESPONSE`` of each level.
* Descriptors: ``BITS`` intensity comparisons of a smoothed patch, turned by the direction of the
  patch's intensity centroid (binary tests, orientation-normalised).
* Hamming tables: the bits are divided ``ROUNDS`` times into parts of ``PART`` bits, and descriptors
  meet that differ in one bit at most of some part. A pair ``DISTANCE`` bits apart meets with
  probability 0.95, a nearer one more surely. Blocks of images and of queries are units of work;
  the tables are built inside a unit, so that a frequent value costs comparisons but no rows.
* Consensus: each match of a query and an image proposes a similarity transform (shift, turn,
  scale); the image is a copy if ``INLIERS`` corners agree with one of them, or more where pictures are
  so large that as many would agree by chance.

Crops, turns, noise, changes of brightness or contrast and sizes from a half to twice are covered, if the
copy has enough corners left.

Images are binary PGM or PPM (P5, P6; colours are averaged). Anything else has no corners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import arrow_map, partitions, table
from sievework.scratch import materialize

SCALES, PATCH = tuple(1.2**-k for k in range(5)), 7
#: Least response of a corner, well above that of rounded grey values; and corners described at a time.
RESPONSE, DESCRIBED = 1e-2, 4096
BITS = 280
#: Bits of a part, and how often the bits are divided into parts.
PART, ROUNDS = 18, 2
#: Most differing bits of a match, and fewest agreeing corners of a copy, and pixels they may be off.
DISTANCE, INLIERS, PIXELS = 56, 6, 2.5
#: Most copies expected among as many matches that agree by chance (Chernoff bound of a Poisson tail).
CHANCE = 1e-4
#: Images of a unit of work, and corners of its queries; they bound a task, not what is compared.
IMAGE_BLOCK, UNIT_CORNERS = 4096, 200_000
#: Corners of images and of queries that meet at a time, and descriptors compared at a time.
INDEX_CORNERS, QUERY_CORNERS, CANDIDATES = 500_000, 2000, 1_000_000

_R = np.random.default_rng(7)
_TESTS = _R.integers(-PATCH, PATCH + 1, size=(BITS, 2, 2)).astype(float)  # (bit, end, xy)
_PARTS = [p for _ in range(ROUNDS) for p in _R.permutation(BITS)[: BITS // PART * PART].reshape(-1, PART)]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM or PPM, None if it is neither."""
    try:
        kind, rest = data[:2], data[2:]
        numbers, at = [], 0
        while len(numbers) < 3:
            while rest[at : at + 1].isspace() or rest[at : at + 1] == b"#":
                at = rest.index(b"\n", at) + 1 if rest[at : at + 1] == b"#" else at + 1
            end = at
            while rest[end : end + 1].isdigit():
                end += 1
            numbers.append(int(rest[at:end]))
            at = end
        w, h, top = numbers
        planes = {b"P5": 1, b"P6": 3}[kind]
        if not 0 < top < 256 or w * h * planes > len(rest):
            return None
        a = np.frombuffer(rest, np.uint8, w * h * planes, at + 1).reshape(h, w, planes)
        return a.mean(2).astype(np.float32) * (255 / top)
    except (TypeError, KeyError, ValueError, IndexError, OverflowError):
        return None


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.round(grey), 0, 255).astype(np.uint8).tobytes()


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, over the last two axes."""
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, a.shape[-2]), (width, a.shape[-1])))
    y0, x0 = np.minimum(y.astype(int), max(a.shape[-2] - 2, 0)), np.minimum(x.astype(int), max(a.shape[-1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, a.shape[-2] - 1), np.minimum(x0 + 1, a.shape[-1] - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None, :].astype(np.float32)
    rows = a[..., y0, :] * (1 - fy) + a[..., y1, :] * fy
    return rows[..., x0] * (1 - fx) + rows[..., x1] * fx


def _box(a: np.ndarray, r: int) -> np.ndarray:
    for axis in (-2, -1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis, dtype=np.float64)
        n = a.shape[axis]
        a = ((np.take(c, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, range(n), axis)) / (2 * r + 1)).astype(np.float32)
    return a


def corners(a: np.ndarray) -> dict[str, np.ndarray]:
    """Corners of images (n, h, w): image, x, y, angle, scale and packed descriptor of each."""
    found, d = [], np.arange(-PATCH, PATCH + 1)
    for scale in SCALES:
        h, w = round(a.shape[1] * scale), round(a.shape[2] * scale)
        if min(h, w) < 2 * PATCH + 6:
            continue
        level = a if scale == 1 else resize(level, h, w)  # from the level before, so that no texture is skipped
        g = _box(level, 1)
        gy, gx = np.gradient(g, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        edge = PATCH + 2
        r[:, :edge], r[:, -edge:], r[:, :, :edge], r[:, :, -edge:] = 0, 0, 0, 0
        peak = r > RESPONSE
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy or dx:
                    near = np.roll(r, (dy, dx), (1, 2))
                    peak &= (r >= near) if (dy, dx) < (0, 0) else (r > near)
        disc = (d[:, None] ** 2 + d[None, :] ** 2) <= PATCH * PATCH
        smooth = _box(g, 1)
        every = np.stack(np.nonzero(peak))
        for k in range(0, every.shape[1], DESCRIBED):
            image, y, x = every[:, k : k + DESCRIBED]
            patch = g[image[:, None, None], y[:, None, None] + d[None, :, None], x[:, None, None] + d[None, None, :]] * disc
            angle = np.arctan2((patch * d[None, :, None]).sum((1, 2)), (patch * d[None, None, :]).sum((1, 2)))
            c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            tx, ty = _TESTS[None, :, :, 0], _TESTS[None, :, :, 1]
            px = np.clip(np.round(x[:, None, None] + c * tx - s * ty), 0, w - 1).astype(int)
            py = np.clip(np.round(y[:, None, None] + s * tx + c * ty), 0, h - 1).astype(int)
            value = smooth[image[:, None, None], py, px]
            bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1)
            found.append((image, x / scale, y / scale, angle, np.full(len(image), scale), bits))
    if not found:
        return {k: np.zeros((0, BITS // 8) if k == "bits" else 0, np.uint8 if k == "bits" else float) for k in ("image", "x", "y", "angle", "scale", "bits")}
    return dict(zip(("image", "x", "y", "angle", "scale", "bits"), (np.concatenate(v) for v in zip(*found))))


_CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f4"), ("scale", "<f4"), ("bits", "u1", BITS // 8)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corners of each image, packed into one row."""
    for b in batches:
        shapes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for i, data in zip(b.column("image_id").to_pylist(), b.column("image").to_pylist()):
            a = decode(data)
            if a is not None and i is not None and a.size:
                shapes.setdefault(a.shape, []).append((i, a))
        for (h, w), own in shapes.items():
            some = max(1, (1 << 18) // (h * w))
            for k in range(0, len(own), some):
                part = own[k : k + some]
                f = corners(np.stack([a for _, a in part]))
                m = np.zeros(len(f["x"]), _CORNER)
                for c in m.dtype.names:
                    m[c] = f[c]
                packed = [m[f["image"] == i] for i in range(len(part))]
                rows = [(i, len(x), x.tobytes()) for (i, _), x in zip(part, packed) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["id", "n", "corners"])


def _keys(bits: np.ndarray) -> np.ndarray:
    """The values of each descriptor's parts."""
    pick = np.zeros((BITS, len(_PARTS)), np.float32)
    for t, own in enumerate(_PARTS):
        pick[own, t] = 2.0 ** np.arange(len(own))
    some = 1 << 14
    return np.concatenate([np.zeros((0, len(_PARTS)), np.uint32), *((np.unpackbits(bits[k : k + some], axis=1).astype(np.float32) @ pick).astype(np.uint32) for k in range(0, len(bits), some))])


class Tables:
    """Descriptors by the values of their parts."""

    def __init__(self, bits: np.ndarray):
        self.words, self.keys = _words(bits), _keys(bits)
        self.order = [np.argsort(k, kind="stable").astype(np.int32) for k in self.keys.T]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(k, minlength=1 << PART))]).astype(np.int32) for k in self.keys.T]

    def search(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``bits``, own row) of descriptors that differ in DISTANCE bits at most and, in some part, in one at most."""
        words, keys = _words(bits), _keys(bits)
        probes = np.concatenate([[0], 1 << np.arange(PART)]).astype(np.uint32)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for t in range(len(_PARTS)):
            at = (keys[:, t, None] ^ probes).reshape(-1)
            lo = self.start[t][at]
            n = self.start[t][at + 1] - lo
            own = np.flatnonzero(n)
            lo, n = lo[own], n[own].astype(np.int64)
            end = np.cumsum(n)
            a = 0
            while a < len(n):
                z = max(a + 1, int(np.searchsorted(end, end[a] - n[a] + CANDIDATES, "right")))
                some = n[a:z]
                i = np.repeat(own[a:z] // len(probes), some)
                j = self.order[t][np.repeat(lo[a:z] - (np.cumsum(some) - some), some) + np.arange(some.sum())]
                off = np.zeros(len(i), np.uint16)
                for k in range(words.shape[1]):
                    off += np.bitwise_count(words[i, k] ^ self.words[j, k])
                    if k:
                        near = off <= DISTANCE
                        i, j, off = i[near], j[near], off[near]
                new = ~(np.bitwise_count(keys[i, :t] ^ self.keys[j, :t]) <= 1).any(1)  # not found by an earlier part
                found.append((i[new], j[new].astype(np.int64)))
                a = z
        return tuple(np.concatenate(x) for x in zip(*found))


def _words(bits: np.ndarray) -> np.ndarray:
    return np.asfortranarray(np.pad(bits, ((0, 0), (0, -BITS // 8 % 8))).view(np.uint64))


def consensus(q: np.ndarray, d: np.ndarray, met: float = 0.0) -> tuple[int, float, float, float, float]:
    """Most corners (different on both sides) that agree with one match's transform, and that transform.

    None (0) if so many would agree by chance with some of as many matches; ``met`` is the share of
    places that are near one another.
    """
    turn, grow = d[:, 2] - q[:, 2], q[:, 3] / d[:, 3]
    z = (grow * np.exp(1j * turn)).astype(np.complex64)
    to, at = (x[:, 0] + 1j * x[:, 1] for x in (d, q))
    to, at, shift = to.astype(np.complex64), at.astype(np.complex64), (to - z * at).astype(np.complex64)
    agree = []
    some = max(1, (1 << 20) // len(q))
    for k in range(0, len(q), some):
        part = slice(k, k + some)
        off = z[part, None] * at + shift[part, None] - to
        turned = z[part, None] - z
        like = turned.real**2 + turned.imag**2 <= (0.4 * grow[part, None]) ** 2
        ok = like & (off.real**2 + off.imag**2 <= PIXELS**2)
        first = int(ok.sum(1).argmax())
        agree.append((int(ok[first].sum()), k + first, np.flatnonzero(ok[first]), int(like[first].sum())))
    _, best, own, alike = max(agree, key=lambda x: x[0])
    n = min(len(np.unique(np.round(x[own, :2]), axis=0)) for x in (q, d))
    chance, more = alike * met, n - 1
    if chance and (more <= chance or more - chance + more * np.log(chance / more) + np.log(len(q)) > np.log(CHANCE)):
        n = 0
    return n, float(turn[best]), float(grow[best]), float(d[best, 0] - q[best, 0]), float(d[best, 1] - q[best, 1])


def crowding(c: np.ndarray) -> float:
    """Share of a picture's pairs of corners that are PIXELS apart at most, at least that of an even spread."""
    place, side = np.stack([c["x"], c["y"]], 1), PIXELS * np.sqrt(np.pi)
    _, n = np.unique(np.floor(place / side), axis=0, return_counts=True)
    pairs = (n * (n - 1.0)).sum() / max(1, len(c) * (len(c) - 1))
    return max(float(pairs), float(np.pi * PIXELS**2 / np.prod(np.ptp(place, axis=0) + 2 * PIXELS)))


def _solve(asked: list[tuple[int, np.ndarray]], images: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Copies among the images, which come with their corners; rows of one image stand together."""
    ids, at = np.repeat([i for i, _ in images], [len(c) for _, c in images]), np.concatenate([c for _, c in images])
    geometry = lambda c: np.stack([c[k] for k in ("x", "y", "angle", "scale")], 1)
    tables, place = Tables(at["bits"]), geometry(at)
    met = {i: crowding(c) for i, c in images}
    k = 0
    while k < len(asked):
        z, n = k, 0
        while z < len(asked) and (z == k or n + len(asked[z][1]) <= QUERY_CORNERS or asked[z][0] == asked[z - 1][0]):
            n += len(asked[z][1])
            z += 1
        who, own = np.repeat([i for i, _ in asked[k:z]], [len(c) for _, c in asked[k:z]]), np.concatenate([c for _, c in asked[k:z]])
        k = z
        i, j = tables.search(own["bits"])
        by = np.lexsort((ids[j], who[i]))
        i, j = i[by], j[by]
        new = np.flatnonzero(np.concatenate([[True], (who[i][1:] != who[i][:-1]) | (ids[j][1:] != ids[j][:-1])])) if len(i) else []
        asked_at, rows = geometry(own), []
        for a, b in zip(new, [*new[1:], len(i)]):
            if b - a >= INLIERS:
                count = consensus(asked_at[i[a:b]], place[j[a:b]], met[int(ids[j[a]])])[0]
                if count >= INLIERS:
                    rows.append((int(who[i[a]]), int(ids[j[a]]), count))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "image_id", "inliers"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a unit: its queries first, then its images by id."""
    unit, asked, images, held = None, [], [], 0
    for b in batches:
        for block, part, side, i, packed in zip(*(b.column(c).to_pylist() for c in ("block", "part", "side", "id", "corners"))):
            if images and ((block, part) != unit or (held >= INDEX_CORNERS and i != images[-1][0])):
                if asked:
                    yield from _solve(asked, images)
                images, held = [], 0
            if (block, part) != unit:
                unit, asked = (block, part), []
            own = np.frombuffer(packed, _CORNER)
            (images if side else asked).append((i, own))
            held += len(own) * side
    if asked and images:
        yield from _solve(asked, images)


def image_copies(images: DataFrame, queries: DataFrame, n_images: int | None = None) -> DataFrame:
    """query_id, image_id, inliers: images (image_id, image) that the queries' images are copies of.

    Null ids and images that are null, empty or of another format match nothing; images too small or
    too plain to have ``INLIERS`` corners neither. Repeated rows are one image; images under one id
    count as one. An empty table on either side gives no rows; other columns are ignored. ``n_images``
    saves a count where the caller knows it; it only says how many blocks there are.
    """
    n = max(1, partitions(images.sparkSession))
    find = lambda df: arrow_map(df.select(F.col("image_id").cast("long").alias("image_id"), F.col("image").cast("binary").alias("image")), _features, "id long, n int, corners binary")
    asked = materialize(find(queries), "img-queries")
    blocks = max(1, -(-(images.select("image_id").count() if n_images is None else n_images) // IMAGE_BLOCK))
    parts = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // UNIT_CORNERS))
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    wanted = asked.select(each(blocks).alias("block"), own(parts).alias("part"), F.lit(0).alias("side"), "id", "corners")
    held = find(images).select(own(blocks).alias("block"), each(parts).alias("part"), F.lit(1).alias("side"), "id", "corners")
    units = wanted.union(held).repartition(n, "block", "part").sortWithinPartitions("block", "part", "side", "id")
    return arrow_map(units, _meet, "query_id long, image_id long, inliers long").groupBy("query_id", "image_id").agg(F.max("inliers").alias("inliers"))


_FIELDS: dict[tuple[int, int], np.ndarray] = {}


def draw(vector: list[float] | None, side: int = 64) -> bytes | None:
    """A vector as a picture: fixed noise fields, one for each component, weighted by it.

    Near vectors give near pictures, unrelated ones unrelated textures. None if it has no finite spread.
    """
    a = np.array([np.nan if x is None else x for x in (vector or [])], float)
    if not len(a) or not np.isfinite(a).all() or a.std() == 0:
        return None
    if (len(a), side) not in _FIELDS:
        noise = np.random.default_rng(len(a)).normal(size=(len(a), side, side)).astype(np.float32)
        _FIELDS[len(a), side] = _box(_box(noise, 1), 1)
    grey = np.tensordot(a.astype(np.float32), _FIELDS[len(a), side], 1)
    return encode_pgm((grey - grey.mean()) / grey.std() * 48 + 128)


def draw_grid(vector: list[float] | None, side: int = 64) -> bytes | None:
    """A vector as a picture: its components on a square grid of grey values, interpolated.

    All have their corners in the same places and much alike. None if it has no finite spread.
    """
    a = np.array([np.nan if x is None else x for x in (vector or [])], float)
    k = int(np.sqrt(len(a)))
    if k < 2 or not np.isfinite(a).all() or a.std() == 0:
        return None
    grid = ((a[: k * k] - a.mean()) / a.std() * 48 + 128).reshape(k, k).astype(np.float32)
    return encode_pgm(resize(grid, side, side))


def edit(data: bytes | None, kind: int = 0) -> bytes | None:
    """One of ``EDITS`` edits: crop an eighth off each side, halve the contrast by a fifth and brighten;
    enlarge by 1.3; turn by a quarter and darken; noise; crop a corner off; shrink to 0.8."""
    a = decode(data)
    if a is None:
        return None
    h, w = a.shape
    if kind == 1:
        return encode_pgm(resize(a, round(h * 1.3), round(w * 1.3)))
    if kind == 2:
        return encode_pgm(np.rot90(a) * 0.9)
    if kind == 3:
        return encode_pgm(a + np.random.default_rng(h * w).normal(scale=8, size=a.shape))
    if kind == 4:
        return encode_pgm(a[h // 4 :, : w - w // 4])
    if kind == 5:
        return encode_pgm(resize(a, round(h * 0.8), round(w * 0.8)))
    return encode_pgm(a[h // 8 : h - h // 8, w // 8 : w - w // 8] * 0.8 + 30)


EDITS = 6


def _pictures(edited: bool):
    """Every fourth group of 20 ids is drawn as grids, the others as noise fields."""

    def one(i: int | None, v: list[float] | None) -> bytes | None:
        group = (i or 0) // 20
        out = (draw if group % 4 else draw_grid)(v)
        return edit(out, group % EDITS) if edited else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(i, v) for i, v in zip(b.column("image_id").to_pylist(), b.column("embedding").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(out, pa.binary())], ["image_id", "image"])

    return run


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images: every row of ``embeddings`` is drawn; the queries are edited copies of the rows whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    images = arrow_map(rows, _pictures(False), "image_id long, image binary")  # drawn when read, never stored
    return image_copies(images, arrow_map(rows.where("image_id % 20 = 0"), _pictures(True), "image_id long, image binary"), rows.count())
