import numpy as np

from sievework.llm import image_copies as ic


def picture(seed, side=64):
    return ic.decode(ic.draw(np.random.default_rng(seed).normal(size=64).tolist(), side))


def test_decode():
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (ic.decode(ic.encode_pgm(a)) == a).all()
    assert ic.decode(b"P6\n# c\n1 1\n255\n\x03\x06\x09")[0, 0] == 6
    assert all(ic.decode(x) is None for x in (None, b"", b"P5", b"P5\n9 9\n255\n1", b"\x89PNG", b"P5\n1 1\n65535\n00", b"P5\n99999999999999999999 1\n255\n", b"P5\n99999999999999999999 0\n255\n", b"P5\n4000000000 4000000000\n255\nxx"))


def test_copies_and_only_copies_are_found(spark):
    images = {i: picture(i) for i in range(60)}
    edits = {
        0: images[0][8:56, 8:56] * 0.8 + 30,
        1: images[1][4:60, 12:64],
        2: np.rot90(images[2]),
        3: images[3] + np.random.default_rng(1).normal(scale=3, size=(64, 64)),
        4: 255 - (255 - images[4][6:, :56]) * 0.7,
        99: picture(1000),
    }
    df = lambda d: spark.createDataFrame([(k, ic.encode_pgm(v), "x") for k, v in d.items()] + [(None, ic.encode_pgm(images[0]), "x"), (70, None, "x"), (71, b"junk", "x"), (72, ic.encode_pgm(np.zeros((64, 64))), "x")], "image_id long, image binary, corner string")
    got = {(r.query_id, r.image_id) for r in ic.image_copies(df(images), df(edits)).collect()}
    assert got == {(i, i) for i in range(5)}
    assert ic.image_copies(df(images).limit(0), df(edits)).count() == 0


def test_postings_in_blocks_find_the_same(spark, monkeypatch):
    images = spark.createDataFrame([(i, ic.encode_pgm(picture(i % 7))) for i in range(30)], "image_id long, image binary")
    whole = sorted(map(tuple, ic.image_copies(images, images.where("image_id < 3")).collect()))
    monkeypatch.setattr(ic, "IMAGE_BLOCK", 4)
    assert sorted(map(tuple, ic.image_copies(images, images.where("image_id < 3")).collect())) == whole
    assert {w[:2] for w in whole} == {(q, i) for q in range(3) for i in range(30) if i % 7 == q}


def test_query_finds_every_source(spark):
    out = {(r.query_id, r.image_id) for r in ic.op1_image_copies(spark, "/root/testdata/sf0.01").collect()}
    asked = [r.vec_id for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id % 20 = 0").collect()]
    assert sum((q, q) in out for q in asked) >= 0.95 * len(asked)
    assert sum(q != i for q, i in out) <= 0.1 * len(asked)


def _within(bits, others):
    """Pairs of descriptors at most DISTANCE bits apart, by brute force."""
    off = np.array([np.bitwise_count(b ^ others).sum(1) for b in bits])
    return set(zip(*(x.tolist() for x in np.nonzero(off <= ic.DISTANCE))))


def test_tables_find_what_brute_force_finds():
    draws = np.random.default_rng(3)
    bits = draws.integers(0, 256, (3000, ic.BITS // 8), dtype=np.uint8)
    far = np.unpackbits(bits[:1000], axis=1)
    for b in far:
        b[draws.permutation(ic.BITS)[: ic.DISTANCE]] ^= 1
    i, j = ic.Tables(bits).search(np.packbits(far, axis=1))
    there, found = _within(np.packbits(far, axis=1), bits), list(zip(i.tolist(), j.tolist()))
    assert len(found) == len(set(found)) and set(found) <= there
    assert len(there) >= 1000 and len(found) >= 0.9 * len(there)


def test_noisy_copies_are_found(spark):
    images = {i: picture(i) for i in range(40)}
    noisy = {i: a + np.random.default_rng(i).normal(scale=25, size=a.shape) for i, a in images.items()}
    df = lambda d: spark.createDataFrame([(k, ic.encode_pgm(v)) for k, v in d.items()], "image_id long, image binary")
    there = 0
    for i in images:
        q, d = (ic.corners(ic.decode(ic.encode_pgm(x[i]))[None]) for x in (noisy, images))
        pairs = sorted(_within(q["bits"], d["bits"]))
        place = lambda f, k: np.stack([f[c][[p[k] for p in pairs]] for c in ("x", "y", "angle", "scale")], 1)  # noqa: B023,E731
        there += len(pairs) >= ic.INLIERS and ic.consensus(place(q, 0), place(d, 1))[0] >= ic.INLIERS
    found = {(r.query_id, r.image_id) for r in ic.image_copies(df(images), df(noisy)).collect()}
    assert there >= 20 and sum((i, i) in found for i in images) >= 0.9 * there


def test_resized_copies_are_found(spark):
    images = {i: picture(i, 64 if i < 20 else 128) for i in range(24)}
    sizes = {0: 84, 1: 84, 2: 96, 3: 52, 4: 48, 20: 84, 21: 64, 22: 200, 23: 256}
    df = lambda d: spark.createDataFrame([(k, ic.encode_pgm(v)) for k, v in d.items()], "image_id long, image binary")
    edits = {i: ic.resize(images[i], n, n) for i, n in sizes.items()}
    found = {(r.query_id, r.image_id) for r in ic.image_copies(df(images), df(edits)).collect()}
    assert found == {(i, i) for i in sizes}


def test_small_crops_of_large_uneven_pictures_are_found(spark):
    """The strongest corners lie in a busy field outside of the crop."""
    images = {}
    for i in range(8):
        a = (picture(i, 256) - 128) * 0.2 + 128
        a[8:72, 8:120] = np.kron(np.random.default_rng(i).integers(0, 2, (8, 14)), np.ones((8, 8))) * 255
        images[i] = a
    edits = {i: images[i][120 + 8 * i : 168 + 8 * i, 150 - 9 * i : 198 - 9 * i] for i in images}
    df = lambda d: spark.createDataFrame([(k, ic.encode_pgm(v)) for k, v in d.items()], "image_id long, image binary")
    found = {(r.query_id, r.image_id) for r in ic.image_copies(df(images), df(edits)).collect()}
    assert found == {(i, i) for i in images}


def test_query_has_structured_pictures_and_several_edits():
    vector = np.random.default_rng(0).normal(size=64).tolist()
    grid = ic.decode(ic.draw_grid(vector))
    at = lambda a: {tuple(x) for x in np.round(np.stack([ic.corners(a[None])[k] for k in "xy"], 1) / 8).astype(int)}
    other = ic.decode(ic.draw_grid(np.random.default_rng(1).normal(size=64).tolist()))
    assert len(at(grid) & at(other)) >= 10
    edited = [ic.decode(ic.edit(ic.draw(vector), k)) for k in range(ic.EDITS)]
    assert len({a.shape for a in edited}) >= 4 and len({a.tobytes() for a in edited}) == ic.EDITS
