import numpy as np
import pytest

pytest.importorskip("lithocube.llm")
from lithocube.llm.packing import Packer, fill_report, hilbert, pack_documents  # noqa: E402
from lithocube.llm.tokens import VOCABULARY, encoder, token_counts  # noqa: E402

DOCS = "doc_id long, text string, key int, n_tokens string, place string"
PACKS = "pack_id long, capacity_tokens int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "", "") for i, t in enumerate(texts)], DOCS)


def test_hilbert_is_a_walk():
    for bits, dims in ((3, 2), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = hilbert(cells, bits)
        assert sorted(key) == list(range(side**dims))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_best_fit():
    p = Packer(10)
    assert [p.put(n) for n in (6, 7, 4, 3, 10, 1)] == [0, 1, 0, 1, 2, 3]


def test_containers_are_closed_along_the_curve():
    p = Packer(10, keep=2)
    p.walk()
    assert p.put(6) == 0
    p.walk()
    assert p.put(7) == 1
    p.walk()
    assert [p.put(3), p.put(4)] == [1, 2]


def test_tokens_are_the_vocabulary_s(spark):
    texts = ["The court held.", "", None, "Das Gericht entschied. " * 300, "<|endoftext|>", "​ naïve"]
    got = {r.doc_id: r for r in token_counts(docs(spark, texts), "doc_id", dims=3).collect()}
    enc = encoder(VOCABULARY)
    assert [got[i].n_tokens for i in range(6)] == [len(enc.encode_ordinary(t or "")) for t in texts]
    assert got[1].place == [0.0] * 3 and len(got[3].place) == 3
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def check(spark, texts, packs, **k):
    d = docs(spark, texts)
    size = {r.doc_id: r.n_tokens for r in token_counts(d, "doc_id").collect()}
    p = pack_documents(d, spark.createDataFrame(packs, PACKS), **k)
    got = p.collect()
    for pack, capacity in packs:
        if pack is None or capacity is None or capacity < 1:
            continue
        mine = [r for r in got if r.pack_id == pack]
        load: dict = {}
        for r in mine:
            load[r.container] = load.get(r.container, 0) + r.n_tokens
        assert max(load.values()) <= capacity
        for doc, n in size.items():
            pieces = sorted((r.first_token, r.n_tokens) for r in mine if r.doc_id == doc)
            assert sum(x for _, x in pieces) == n
            assert len(pieces) == (0 if n == 0 else 1 if n <= capacity else -(-n // capacity))
            assert [a for a, _ in pieces] == [i * capacity for i in range(len(pieces))]
    return p, got


def test_all_in_and_little_room_left(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["court", "ruling", "appeal", "party"], rng.integers(1, 300))) for _ in range(1500)] + ["", None, "word " * 5000]
    packs = [(1, 256), (2, 1024), (None, 5), (3, None), (4, 0)]
    p, got = check(spark, texts, packs)
    used = {r.pack_id: r.used for r in fill_report(p, spark.createDataFrame(packs, PACKS)).collect()}
    assert used[1] > 0.97 and used[2] > 0.98 and set(used) == {1, 2}
    _, many = check(spark, texts[:400], packs[:2], per_task=100)
    assert len({r.container >> 36 for r in many}) == 4


def test_neighbours_share_containers(spark):
    a, b = "the court dismissed the appeal of the claimant ", "суд отклонил жалобу заявителя "
    texts = [(a if i % 2 else b) * (1 + i % 5) for i in range(400)]
    _, got = check(spark, texts, [(1, 512)], stretch=50)
    kinds: dict = {}
    for r in got:
        kinds.setdefault(r.container, set()).add(r.doc_id % 2)
    assert sum(len(k) == 1 for k in kinds.values()) > 0.5 * len(kinds)


def test_report_counts_documents_and_distance(spark):
    texts = ["court " * 2500, "ruling " * 30, "", "appeal " * 40]
    packs = spark.createDataFrame([(1, 1000)], PACKS)
    r = fill_report(pack_documents(docs(spark, texts), packs), packs).first()
    assert r.documents == 3 and r.cut == 1 and r.containers == 3
    mixed = ["the court dismissed the appeal " * 3 if i % 2 else "суд отклонил жалобу " * 3 for i in range(3000)]
    packs = spark.createDataFrame([(1, 256)], PACKS)
    near = fill_report(pack_documents(docs(spark, mixed), packs, stretch=100), packs).first()
    anywhere = fill_report(pack_documents(docs(spark, mixed), packs, stretch=100_000, keep=0), packs).first()
    assert near.used > 0.95 and near.apart < 0.5 and near.apart <= anywhere.apart + 1e-9


def test_empty(spark):
    packs = spark.createDataFrame([(1, 10)], PACKS)
    assert pack_documents(docs(spark, []), packs).count() == 0
    assert pack_documents(docs(spark, ["a b"]), packs.limit(0)).count() == 0
    assert pack_documents(docs(spark, [None, ""]), packs).count() == 0
