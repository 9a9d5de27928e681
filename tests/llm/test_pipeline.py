"""The pipeline against plain versions of its stages, on a small table with odd rows."""

import brute
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from metrolith.llm import langid, mixing
from metrolith.llm._common import materialize
from metrolith.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest table with nulls in every column, repeated rows and ids, empty and long texts."""
    path = tmp_path_factory.mktemp("sf")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in real.where("lang = 'en' and length(text) between 300 and 2000").orderBy("doc_id").limit(6).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    a, b, c, d, e, f = texts
    odd = [
        (None, None, None, None, None), (10001, "", "en", "src0", 0), (10002, " \n\t ", None, "src1", 4), (10003, "123 !!", "en", None, 6),
        (10004, a, "en", "src0", 7), (10004, a, "en", "src0", 7), (10005, b + " " + item + " " + c, "en", "src1", 9), (None, c + " " + d, "en", None, 1),
        (None, d + " " + e, None, "src2", None), (10006, e + " " + f, "en", "src0", 1), (10006, f + " " + a, "en", "src0", 1), (10007, (b + " ") * 300, "en", "src2", None),
    ]
    real.union(spark.createDataFrame(odd, SCHEMA)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", *map(str, r[2:]))


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rows, key=key)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)

    def step(name):
        out = materialize(stages[name](spark, docs, folder), name)
        assert name == "token_output" or out.columns == columns
        return out

    rows = [tuple(r) for r in docs.collect()]
    model = langid.fit(docs)
    rows = [r for r in rows if not model.predict(r[1] or "")[2]]
    docs = step("language_id")
    same(docs, rows)
    assert 150 < len(rows) < 209

    group = brute.groups([brute.fingerprint(r[1]) for r in rows])
    best = {}
    for r in rows:
        g = group[brute.fingerprint(r[1])]
        if g not in best or key(r)[:2] < key(best[g])[:2]:
            best[g] = r
    before, rows = len(rows), list(best.values())
    docs = step("simhash_near_dedup")
    same(docs, rows)
    assert len(rows) < before

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {place for place, _ in brute.overlaps([r[1] for r in rows], items)}
    assert any(rows[k][0] == 10005 for k in bad)
    rows = [r for k, r in enumerate(rows) if k not in bad]
    docs = step("benchmark_decontamination")
    same(docs, rows)

    of_text = {(r[0], len((r[1] or "").split()), r[3]): r for r in rows}
    assert len(of_text) == len(rows)
    planned = brute.schedule(mixing.sizes_of(docs).collect())
    rows = [of_text[r["row_id"], r["size"], r["source"]] for r, *_, copies in planned for _ in range(copies)]
    docs = step("source_mixing")
    same(docs, rows)

    expected = brute.tokens([r[:2] for r in rows], Tokenizer.from_file(tokenizer_path()))
    out = sorted(map(tuple, step("token_output").collect()), key=lambda r: r[1])
    assert out == expected
    assert sorted(map(tuple, P.run(spark, folder).collect()), key=lambda r: r[1]) == expected


def test_empty_tables(spark, folder, tmp_path):
    for name, keep in (("nothing", False), ("wordless", True)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").where("text is null or trim(text) = ''" if keep else "false")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = P.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
