import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_op3_decontam, test_op9_simhash, test_op10_suffix_dedup
from turnweave.llm import op1_toxicity


def fixture(folder, spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("etaoinshr", k=r.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(6)]
    passage = " ".join(word() for _ in range(70))
    docs = []
    for i in range(160):
        words = [word() for _ in range(r.randrange(30, 160))]
        if i % 4 == 0:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["vileword", "nastyword"])
        if i % 10 == 1:
            words[7:7] = items[i % 6][1].split()
        if i % 10 == 3:
            words[9:9] = passage.split()
        docs.append([i, " ".join(words), "en", f"s{i % 3}", 0])
    docs += [[500 + k, docs[k][1], "fr", None, 0] for k in (1, 3, 5, 7)] + [[600, None, None, None, None], [601, "", "en", "s", 0], [602, docs[9][1].replace(" ", "  "), "en", "s", 0]]
    for d in docs:
        d[4] = None if d[1] is None else len(d[1])
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 160)]
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d for d in docs}, items


def test_every_stage_matches_brute_force_on_its_own_input(spark, tmp_path):
    docs, items = fixture(tmp_path, spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_dedup", "decontamination", "bpe"]
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = own.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: tuple(r) for r in own.collect()}
        out = stage(spark, own, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        own = spark.read.parquet(path)
        if name != "bpe":
            assert own.columns == columns
        after = {r[0]: tuple(r) for r in own.collect()}
        assert own.count() == len(after)
        if name == "toxicity":
            model = op1_toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
            scorer = op1_toxicity.Scorer(model)
            assert after == {k: v for k, v in before.items() if scorer.score([v[1]])[0] < 0.5}
            gone = before.keys() - after.keys()
            assert sum(k < 160 and k % 4 == 0 for k in gone) >= 38 and sum(k >= 160 or k % 4 > 0 for k in gone) <= 4
        elif name == "simhash_near_dedup":
            want = {d for d, _, c in test_op9_simhash.brute([(k, v[1]) for k, v in before.items()]) if d == c}
            assert after == {k: v for k, v in before.items() if k in want}
        elif name == "suffix_dedup":
            kept = {d: sha for d, _, _, _, sha in test_op10_suffix_dedup.brute([(k, v[1]) for k, v in before.items()], 100)}
            assert after.keys() == before.keys()
            for k, v in after.items():
                assert hashlib.sha256((v[1] or "").encode()).hexdigest() == kept[k]
                assert v[2:4] == before[k][2:4] and v[4] == (None if v[1] is None else len(v[1]))
            assert sum(v[4] or 0 for v in after.values()) < sum(v[4] or 0 for v in before.values())
        elif name == "decontamination":
            held = {d for d, *_ in test_op3_decontam.brute([(k, v[1]) for k, v in before.items()], items)}
            assert held and after == {k: v for k, v in before.items() if k not in held}
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            for k, v in before.items():
                ids = t.encode(v[1] or "", add_special_tokens=False).ids
                assert after[k] == (k, len(ids), ids, t.decode(ids, skip_special_tokens=False))
    assert np.array_equal(sorted(r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), sorted(after))


def test_stages_keep_columns_of_any_name_and_hold_odd_rows(spark, tmp_path):
    word = lambda i: f"w{i * 7919 % 9973:x}"
    text = lambda a, n: " ".join(word(a * 1000 + k) for k in range(n))
    rows = [(1, text(1, 60), "x"), (1, text(2, 60), "y"), (None, text(3, 60), None), (None, None, "z"), (4, None, "u"), (5, "", "v"), (6, text(1, 60), "copy"), (7, "é" * 30_000, "long"), (8, "é" * 30_000 + "ü", "long"), (9, "vileword " + text(9, 40), "t"), (10, text(4, 80), "item")]
    rows += [(100 + i, ("vileword " if i % 2 else "") + text(20 + i, 30), "l") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", "cast(length(text) as long) AS n_chars", "'e' AS lang", "1 AS `a.b`", "2 AS id", "3 AS h", "4 AS `group`", "5 AS node", "6 AS of_0", "7 AS w", "8 AS chunk", "9 AS doc", "'q' AS t").repartition(3)
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(20)] + [(999, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, text(4, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = {"toxicity": set(), "simhash_near_dedup": {6, 5}, "suffix_dedup": set(), "decontamination": {10}}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path)).collect()
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.collect() == []
        ids = [r.doc_id for r in got]
        if name == "bpe":
            assert sorted(ids, key=str) == sorted((r[0] for r in rows), key=str)
            continue
        assert none.columns == docs.columns == list(got[0].__fields__)
        assert {(r["a.b"], r["id"], r["h"], r["group"], r["node"], r["of_0"], r["w"], r["chunk"], r["doc"], r["t"]) for r in got} == {(1, 2, 3, 4, 5, 6, 7, 8, 9, "q")}
        assert ids.count(None) == 2
        if name != "toxicity":
            assert set(ids) == {r[0] for r in rows} - gone[name], name
            assert ids.count(1) == 2
