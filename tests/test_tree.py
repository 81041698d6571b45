"""Folders of files as a data source, and the lookup of words under skew."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexspark import queries as Q
from lexspark.operators import histories, lint, translate
from lexspark.sources import readers, sinks, tree


def rows(spark, *files):
    return spark.createDataFrame(list(files), "file string, text string")


def test_files_of_all_kinds(spark, tmp_path):
    root = tmp_path / "d"
    (root / "a/deep").mkdir(parents=True)
    (root / "none.txt").write_bytes(b"")
    (root / "top.txt").write_bytes(b"x\r\ny\n")
    (root / "a/bad.txt").write_bytes(b"ok \xff")
    (root / "a/deep/ß é.txt").write_text("þ", encoding="utf-8")
    (root / "a/other.json").write_text("{}")
    for hidden in (".x.txt", "_x.txt", "a/_SUCCESS.txt"):
        (root / hidden).write_text("hidden")
    got = {r.file: (r.text, r.corrupt) for r in tree.read_tree(spark, str(root)).collect()}
    assert got == {"none.txt": ("", None), "top.txt": ("x\r\ny\n", None), "a/bad.txt": (None, "invalid start byte at byte 3"), "a/deep/ß é.txt": ("þ", None)}
    assert [r.file for r in tree.read_tree(spark, f"file://{root}", ".json").collect()] == ["a/other.json"]
    assert tree.read_tree(spark, str(root), slices=1).count() == tree.read_tree(spark, str(root), slices=50).count() == 4
    assert "none.txt" not in {r.file for r in readers.text_files(spark, str(root)).collect()}  # why this source is there
    codes = spark.createDataFrame([("n",)], "code string")
    assert ("none.txt", "L1") in {(r.file, r.rule) for r in lint.issues(tree.read_tree(spark, str(root)), codes).collect()}


def test_empty_and_absent_folders(spark, tmp_path):
    assert tree.read_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(PySparkException):
        tree.read_tree(spark, str(tmp_path / "absent")).count()


def test_files_are_written_whole_in_their_place(spark, tmp_path):
    root = str(tmp_path / "out")
    tree.write_tree(rows(spark, ("a/x.txt", "1\n"), ("/b/c/y y.txt", None), ("z.txt", "é" * 1_000_000)), root)
    tree.write_tree(rows(spark, ("a/x.txt", "2"), ("a/x.txt", "2")), root)  # as a task that runs again
    got = {r.file: r.text for r in tree.read_tree(spark, root).collect()}
    assert got == {"a/x.txt": "2", "b/c/y y.txt": "", "z.txt": "é" * 1_000_000}
    assert not [p for p in (tmp_path / "out").rglob(".*")]
    for name in ("../x.txt", "a/../../x.txt", "", None):
        with pytest.raises(PySparkException, match="not the name of a file"):
            tree.write_tree(rows(spark, (name, "x")), root)
    assert not (tmp_path / "x.txt").exists()


def test_many_files_by_the_executors(spark, tmp_path):
    made = spark.range(5000).select(F.concat(F.lit("one/"), "id", F.lit(".txt")).alias("file"), F.col("id").cast("string").alias("text"))
    tree.write_tree(made.repartition(7), str(tmp_path))
    back = tree.read_tree(spark, str(tmp_path))
    assert back.where("file = concat('one/', text, '.txt')").count() == 5000
    spread = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(spread) == tree.SLICES and max(spread) < 2 * min(spread)  # one folder is shared among tasks


def test_history_files(spark, tmp_path):
    told = spark.createDataFrame([("a", "x_noun.txt", "1\n2"), ("", "y_verb.txt", "")], "dir string, name string, text string")
    assert sinks.write_histories(told, str(tmp_path / "none"), dry_run=True) == ["/y_verb.txt", "a/x_noun.txt"] and not (tmp_path / "none").exists()
    sinks.write_histories(told, str(tmp_path / "h"))
    assert (tmp_path / "h/a/x_noun.txt").read_text() == "1\n2\n" and (tmp_path / "h/y_verb.txt").read_text() == "\n"


def test_broken_token_files(spark):
    files = rows(spark, ("a", '[{"text":"x"}]'), ("b", "[{"), ("c", ""), ("d", None), ("e", "[]"))
    assert sorted(r.file for r in readers.broken_token_files(files).collect()) == ["b", "c", "d"]
    assert [(r.doc_id, r.tok_idx, r.text) for r in readers.tokens_of(files).collect()] == [("a", 0, "x")]


def test_a_word_that_is_half_of_all_tokens(spark):
    """With plain shuffles, no task has more than twice the median's rows, and each token has the word it has alone."""
    one = F.when(F.col("id") % 2 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), F.col("id") % 5003))
    made = spark.range(40_000).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("tok_idx"), one.alias("text"), one.alias("lemma"), F.when(F.col("id") % 2 == 0, "DET").otherwise("NOUN").alias("pos"), F.lit("NN").alias("tag"), F.lit(False).alias("is_ent"), F.lit(" ").alias("whitespace")
    )
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("false", "-1", "8")):
            spark.conf.set(k, v)
        done = translate.transcribe(made, Q.lexicon(spark))
        sizes = sorted(r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 40_000 and len(sizes) == 8 and sizes[-1] < 2 * sizes[4]
        assert [(r.text == "the", r.word[:1], r["count"]) for r in done.groupBy("text", "word").count().orderBy(F.desc("count")).limit(1).collect()] == [(True, "þ", 20_000)]
        assert done.where("text <> 'the' AND word = concat('[', text, ']') AND missing = text").count() == 20_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_tokens_with_nulls_stay(spark):
    made = spark.createDataFrame([(1, 0, "cake", None, None, None, None, " "), (1, 1, "the", "the", "DET", None, False, "")], "doc_id int, tok_idx int, text string, lemma string, pos string, tag string, is_ent boolean, whitespace string")
    got = {r.tok_idx: r for r in translate.transcribe(made, Q.lexicon(spark)).collect()}
    assert len(got) == 2 and got[1].word == "þe" and got[0].text == "cake"
    assert translate.transcribe(made.limit(0), Q.lexicon(spark)).count() == 0


def test_a_slice_is_read_in_batches_of_bounded_text(tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "BATCH_CHARS", 1000)
    for i in range(30):
        (tmp_path / f"{i}.txt").write_text("x" * 400)
    reader = tree.TreeReader({"path": str(tmp_path), "ending": ".txt", "slices": "1"})
    batches = list(reader.read(tree.Slice(str(tmp_path), False, 0)))
    assert sum(b.num_rows for b in batches) == 30 and max(b.num_rows for b in batches) == 3


def test_archives_hold_the_same_files(spark, tmp_path, monkeypatch):
    long = "d/" + "þ" * 90 + "/x.txt"  # over the hundred bytes of a plain header
    given = rows(spark, ("a/x.txt", "1\n"), ("/b/c/y y.txt", None), (long, "é" * 100_000), ("a/z.json", "{}"), ("a/.h.txt", "hidden"))
    tree.write_tree(given, str(tmp_path / "p"), archives=True)
    got = {r.file: (r.text, r.corrupt) for r in tree.read_tree(spark, str(tmp_path / "p"), archives=True).collect()}
    assert got == {"a/x.txt": ("1\n", None), "b/c/y y.txt": ("", None), long: ("é" * 100_000, None)}
    assert not list((tmp_path / "p").glob(".*.tar.gz"))
    tree.write_tree(given.limit(0), str(tmp_path / "none"), archives=True)
    assert tree.read_tree(spark, str(tmp_path / "none"), archives=True).count() == 0
    with pytest.raises(PySparkException, match="not the name of a file"):
        tree.write_tree(rows(spark, ("../x.txt", "x")), str(tmp_path / "bad"), archives=True)
    assert not list((tmp_path / "bad").rglob("*.tar.gz"))
    (tmp_path / "p/.stale.tar.gz").write_bytes(b"of a task that was lost")
    assert tree.read_tree(spark, str(tmp_path / "p"), archives=True).count() == 3


def test_small_files_don_t_take_a_block_each(spark, tmp_path):
    """A hundred and twenty thousand files of a few bytes take under a hundred bytes each, in archives of bounded size."""
    made = spark.range(120_000).select(F.concat(F.lit("one/"), "id", F.lit(".txt")).alias("file"), F.col("id").cast("string").alias("text"))
    tree.write_tree(made.coalesce(1), str(tmp_path), archives=True)
    held = list(tmp_path.glob("*.tar.gz"))
    assert len(held) == 3 and sum(f.stat().st_blocks * 512 for f in held) < 120_000 * 100
    back = tree.read_tree(spark, str(tmp_path), archives=True)
    assert back.where("file = concat('one/', text, '.txt')").select("file").distinct().count() == 120_000 == back.count()


def test_histories_of_one_name_meet(spark):
    """Word and part of speech can be told apart in two ways; the last stanza has the name."""
    one, two = "a_b [ME]\nx (c)", "a [ME]\nx (b c)"
    got = histories.split_histories(rows(spark, ("d/1.txt", one), ("d/2.txt", two))).collect()
    assert [(r.name, r.word, r.pos) for r in got] == [("a_b_c.txt", "a", "b_c")]


def test_tree_histories_packs_its_files(spark, monkeypatch):
    roots = []
    monkeypatch.setattr(tree, "write_tree", lambda files, root, archives=False, write=tree.write_tree: (roots.append(root), write(files, root, archives)))
    got = Q.tree_histories(spark, "/root/testdata/sf0.001").count()
    held = list(Path(roots[0].removeprefix("file:").replace("///", "/")).rglob("*"))
    assert got > 1000 and sum(f.is_file() for f in held) < 100
