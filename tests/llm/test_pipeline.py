"""The pipeline's stages on planted rows and its result on the small tables."""

import numpy as np

import corpus_pipeline as pipeline
from armlift.llm.encoders import load_tokenizer


def test_run_is_the_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = set()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in rows.collect()} <= {r.doc_id for r in docs.collect()}
        docs, ids = rows, {r.doc_id for r in rows.collect()}
    packed = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == ids
    tokenizer = load_tokenizer()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sum(r.length for r in packed) == sum(
        len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())


def test_dedup_stage_keeps_one_row_of_each_group(spark, make_docs, folder):
    rng = np.random.default_rng(5)
    text = " ".join(f"w{x}" for x in rng.integers(0, 900, 50))
    other = " ".join(f"w{x}" for x in rng.integers(0, 900, 50))
    docs = make_docs([(4, text, "a"), (2, text + " end", "b"), (2, text + " end", "b"), (9, other, "a"), (1, None, "a"),
                      (3, "", "a")])
    out = pipeline.drop_near_copies(spark, docs, folder)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 9] and out.columns == docs.columns


def test_dedup_stage_leaves_unrelated_rows(spark, make_docs, folder):
    rng = np.random.default_rng(6)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) for _ in range(9)]
    rows = [(None, text[0], "a"), (None, text[1], "a"), (None, text[2], "a"), (None, text[2], "b"),  # one null copy goes
            (7, text[3], "a"), (7, text[4], "a"), (7, text[4] + " end", "a"),  # one id: two groups
            (8, text[5], "a"), (8, text[5], "a"), (9, text[5] + " end", "a"), (None, text[5], "a"),  # one group
            (5, None, "a"), (5, None, "a"), (6, text[6], "a")]
    out = pipeline.drop_near_copies(spark, make_docs(rows), folder)
    assert out.columns == make_docs(rows).columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = [(None, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[4]), (8, text[5]), (5, None), (5, None),
            (6, text[6])]
    ends = [(i, t.removesuffix(" end") if t else t) for i, t in got]  # which of the two comes first is the input's order
    assert sorted(ends, key=repr) == sorted(want, key=repr)


def test_rules_stage_takes_frequent_lines_out_of_the_text(spark, make_docs, folder):
    rng = np.random.default_rng(8)

    def prose(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 9000, n))

    own = [f"  {prose(12)}\n\n{prose(9)} é\n" for _ in range(60)]
    rows = [(k, f"Follow us \there\n{own[k]}follow US here", "a" if k < 40 else None) for k in range(60)]
    rows += [(100, "Follow us here\n" + prose(20), "b"), (101, "follow us here", "a"), (102, None, "a")]
    rows += [(103, rows[0][1], "b"), (0, rows[0][1], "b"), (104, f"{prose(12)} follow us here", "a")]
    docs = make_docs(rows)
    out = pipeline.apply_rules(spark, docs, folder)
    assert out.schema == docs.schema
    want = {(k, "a"): own[k].removesuffix("\n") for k in range(40)}
    want |= {(i, s): t for i, t, s in rows if i in (100, 103, 104) or s is None or (i, s) == (0, "b")}
    got = out.collect()
    assert {(r.doc_id, r.source): r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_stages_on_an_empty_table(spark, make_docs, folder):
    none = make_docs([])
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_rules_stage_with_clashing_columns(spark, folder):
    line = "a line that all of the host's documents share with each other"
    rows = [(i, f"{line}\n" + " ".join(f"word{i}x{k}" for k in range(30)), "en", "h", 1, *range(6)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_ int, "
                                       "lines_ int, host_ int, hash_ int, rules_kept int, RULES_LINES int")
    out = pipeline.apply_rules(spark, docs, folder)
    assert out.columns == docs.columns and out.count() == 60
    assert all(line not in r.text and r.lines_ == 1 and r.n_chars == len(r.text) for r in out.collect())
