import pytest

import corpus_pipeline
from joinlens.llm import decontaminate, neardup, pii, registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_act(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        weights = pii.learn(docs) if name == "personal_data" else None
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before)
        if name == "near_duplicates":
            assert neardup.near_duplicates(docs).where("not kept").count() == 0 and len(after) < len(before)
        if name == "decontamination":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "personal_data":
            assert set(after) == set(before)
            assert all(t == pii.redacted(before[i], weights) for i, t in after.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_run_equals_the_stages_by_brute_force(make, spark, tmp_path):
    """All pairs of shingle sets, all regions of all texts, the patterns, and plain best-fit decreasing, after what language ID accepts."""
    import random
    import re
    import zlib

    import numpy as np

    from joinlens.llm import langid, packing
    from test_neardup import brute
    from test_small_operators import plain_spans, sellers

    rng = random.Random(17)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(3, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(20)) for i in range(4)]
    rows = [(i, text(rng.choice([30, 60, 90]))) for i in range(40)]
    rows += [(40 + i, rng.choice(rows)[1] + (" changed" if i % 2 else "")) for i in range(12)]
    rows += [(60 + i, f"{text(30)} {items[i % 4][1].upper()} {text(20)}") for i in range(6)]
    rows += [(70 + i, f"{text(20)} write to {w}.{i}@mail{i}.org or 10.0.{i}.7 {text(20)}") for i, w in enumerate(words[:6])]
    rows += [(80, None), (81, "12 34"), (83, text(5000))]
    odd = (82, "".join(chr(rng.randrange(0x4E00, 0x6000)) for _ in range(400)))
    make(rows).unionByName(make([odd], lang=None)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judged = langid.predict(docs, langid.fit(docs)).collect()
    left = {i: t for i, t in [*rows, odd] if i in {r["doc_id"] for r in judged if not r["rejected"]}}
    assert not {80, 81, 82} & set(left) and len(left) > 50
    kept = {i: left[i] for i, (_, _, keep) in brute(list(left.items()), 80).items() if keep}
    assert len(kept) <= len(left) - 10
    index = decontaminate.build(items)
    clean = {i: t for i, t in kept.items() if all(sellers(p, decontaminate.normalised(t)) > k for p, k in zip(index.texts, index.budget, strict=True)) or not t}
    assert len(clean) == len(kept) - 6

    def redacted(t):
        for kind, a, b in reversed(plain_spans(t)):  # none overlap here
            t = t[:a] + f"<{kind.upper()}>" + t[b:]
        return t

    encode = packing.encoder(packing.default_vocabulary()).encode
    ids = {i: np.array([*encode(redacted(t), allowed_special="all"), packing.END_ID], "<u4") for i, t in clean.items()}
    pieces = {(i, a): x[a : a + 2048] for i, x in ids.items() for a in range(0, len(x), 2048)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in out} == {k: (len(x), zlib.crc32(x.tobytes())) for k, x in pieces.items()}
    assert any(re.search("<EMAIL>|<IP>", redacted(t)) for t in clean.values())
    room = []  # plain best-fit decreasing
    for n in sorted((len(x) for x in pieces.values()), reverse=True):
        fits = [x for x in room if x >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 2048) - n)
    assert len({r["sequence_id"] for r in out}) == len(room)


def test_names_and_registration():
    import __spark_entry__

    assert set(registry.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    names = list(expected.columns)
    assert rows == sorted((tuple(r[names.index(c)] for c in order) for r in expected.fetchall()), key=repr)


def test_stages_take_odd_tables(make, spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "12 34"), (None, "a text with no id at all"), (4, "the same words are here again today"), (4, "the same words are here again today"), (5, "mail a.b9@x.org now, please do " * 400)]
    for docs in (make(rows).selectExpr("*", "'x' as node", "1L as item_id", "2 as kept"), make(rows).limit(0)):
        names = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == names
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {r["doc_id"] for r in out} <= {None, 4, 5}
    assert not out
