"""Parser, compiler, translator and the rest on hand-derived cases."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from lexspark import fixtures as X
from lexspark.functions import geometry as G
from lexspark.functions import keys, text
from lexspark.operators import analytics, brain, graph, lint, stanzas, translate
from lexspark.plans import pipelines
from lexspark.sources import readers, sinks
from lexspark.streaming import books


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(X.FILES, "file string, text string")


@pytest.fixture(scope="module")
def parsed(spark, files):
    return {(r.file, r.stanza_idx): r for r in stanzas.parse(files).collect()}


def slots(r):
    return [r.conjugations[s] for s in stanzas.SLOTS]


def test_classifier(parsed):
    assert slots(parsed["c/claw.txt", 1]) == ["", "-s", "-d", "-d", "-ing"]
    assert slots(parsed["s/see.txt", 1]) == ["", "-s", "sau", "sine", "-ing"]
    assert slots(parsed["w/work.txt", 1]) == ["uirc", "uircs", "-d", "-d", "-ing"]
    assert slots(parsed["f/fare.txt", 1]) == ["fere", "feres", "foer", "faren", "fering"]
    will = parsed["w/will.txt", 1]
    assert will.conj_kind == "explicit" and [(p.eng, p.ing) for p in will.conjugations.explicit] == [("would", "oûd"), ("won't", "uon't"), ("wouldn't", "oûdn't")]
    assert parsed["w/would.txt", 1].conj_kind == "empty"
    be = parsed["b/be.txt", 1]
    assert be.conj_kind == "empty" and be.warnings
    assert slots(parsed["b/am.txt", 1]) == ["", "am", "", "", ""]
    seer = parsed["s/seer.txt", 1].conjugations
    assert (seer.plural, seer.variants) == ("-s", ["sihor"])
    alternate = parsed["a/alternate.txt", 1].conjugations
    assert (alternate.plural, alternate.forms) == ("-s", ["-ly"])
    assert parsed["h/hammer.txt", 1].conjugations.plural == "hamirs"
    assert parsed["q/quick.txt", 1].conjugations.forms == ["-ly"]


def test_lines(parsed):
    assert parsed["t/two.txt", 1].reformed_word == "tou"  # the last reformed line wins
    assert parsed["r/return.txt", 1].reformed_word == "retoúrn"
    escape = parsed["e/escape.txt", 1]
    assert [e.form for e in escape.etymology] == ['es"ca\\pe', "es\tcape"] and escape.sources == ['http://a.b/"x\\y']
    assert ("w/white.txt", 1) in parsed and ("w/white.txt", 2) not in parsed  # blanks don't end a stanza
    assert parsed["l/lone.txt", 1].me_word == ""


def test_accounts_and_partitions(spark, files):
    all_of = stanzas.stanzas(files).count()
    assert all_of - stanzas.parse(files).count() == stanzas.rejects(files).count()
    whole = sorted(map(str, stanzas.parse(files).collect()))
    for n in (1, 3, 16):
        assert sorted(map(str, stanzas.parse(files.repartition(n)).collect())) == whole


def test_json_round_trip(spark, files):
    import json

    lines = [json.loads(r.line) for r in analytics.json_lines(stanzas.parse(files)).collect()]
    assert any(e["form"] == 'es"ca\\pe' for x in lines for e in x["etymology"])


def lcg(seed):
    while True:
        seed = (seed * 1664525 + 1013904223) % 2**32
        yield seed / 2**32


def test_morphology_and_casing(spark):
    want = ["", "did", "went", "books", "sadly", "translated", "making", "cyngs", "mâcs", "makes", "statement", "bying", "mâching", "comittis", "-s", None, "seed", "flyies"]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(X.FORMS)], "i int, form string, root string, gerund boolean")
    got = [r.x for r in rows.select("i", text.resolve_form(F.col("form"), F.col("root"), F.col("gerund")).alias("x")).orderBy("i").collect()]
    assert got == [None, *want[1:]]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(X.CASES)], "i int, a string, b string")
    got = [r.x for r in rows.select("i", text.match_casing(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == ["hialo", "Hialo", "HIALO", "Ћe", "ЋE", "Hialo", "HIALO", "hialo", "AN", "x", "x", "x", "fone"]


@pytest.mark.parametrize("seed", [101, 202, 303])
def test_morphology_properties(spark, seed):
    draw = lcg(seed)
    word = lambda n: "".join("abcdefghiklmnoprstuvyâîþ"[int(next(draw) * 24)] for _ in range(1 + int(next(draw) * n)))
    rows = spark.createDataFrame([(word(8), word(4)) for _ in range(300)], "root string, suffix string")
    got = rows.select("root", "suffix", text.resolve_form(F.concat(F.lit("-"), "suffix"), F.col("root")).alias("a"), text.resolve_form(F.col("root"), F.col("suffix")).alias("b")).collect()
    for r in got:
        assert r.a.endswith(r.suffix) and "-" not in r.a and len(r.a) >= len(r.suffix) + len(r.root) - 2
        assert r.b == r.root  # what isn't a suffix stays


def test_compiler(spark, parsed, files):
    compiled = {(r.eng, r.category): r for r in brain.compile_brain(stanzas.parse(files)).collect()}
    assert compiled["can", "Modal"].form == "can" and compiled["could", "Modal"].form == "coûd"
    assert compiled["cannot", "Modal"].form == "cânt" and ("cannot", "Verb") in compiled
    assert compiled["would", "Verb"].form == "oûd"
    assert ("a", "Determiner") not in compiled
    tiger = compiled["tiger", "Noun"]
    assert tiger.form == "tîgre" and tiger.conj.conjugations.plural == "tîgars"
    rows = [(1, "x", "Noun", "one", "first"), (2, "x", "Noun", "two", None), (3, "x", "Verb", "v", None)]
    got = {r.category: r for r in brain.merged(spark.createDataFrame(rows, "ord int, eng string, category string, form string, conj string")).collect()}
    assert (got["Noun"].form, got["Noun"].conj, got["Noun"].cat_ord) == ("two", "first", 1)


def said(spark, *tokens):
    rows = [(1, i, t, lemma, pos, tag, False, " " if i + 1 < len(tokens) else "") for i, (t, lemma, pos, tag) in enumerate(tokens)]
    return spark.createDataFrame(rows, "doc_id int, tok_idx int, text string, lemma string, pos string, tag string, is_ent boolean, whitespace string")


def translated(spark, *tokens):
    from lexspark.queries import lexicon

    done = pipelines.translate_books(said(spark, *tokens), lexicon(spark))
    return done["texts"].first().text, [r[0] for r in done["missing"].collect()], [r[0] for r in done["fallbacks"].collect()]


def test_translation(spark):
    assert translated(spark, ("She", "she", "PRON", "PRP"), ("makes", "make", "VERB", "VBZ"), ("the", "the", "DET", "DT"), ("cakes", "cake", "NOUN", "NNS"), (".", ".", "PUNCT", "."))[0] == "Sie mâcs þe caix ."
    assert translated(spark, ("She", "she", "PRON", "PRP"), ("made", "make", "VERB", "VBD"), ("the", "the", "DET", "DT"), ("cake", "cake", "NOUN", "NN"))[0] == "Sie mâde þe câc"
    assert translated(spark, ("She", "she", "PRON", "PRP"), ("circles", "circle", "VERB", "VBZ"), ("the", "the", "DET", "DT"), ("circles", "circle", "NOUN", "NNS"))[0] == "Sie circles þe circuls"
    assert translated(spark, ("quick", "quick", "ADJ", "JJ"), ("zebra", "zebra", "NOUN", "NN")) == ("quic [zebra]", ["zebra"], ["quick (ADJ → Noun)"])
    assert translated(spark, ("fox", "fox", "NOUN", "NN"), ("jumped", "jump", "VERB", "VBD")) == ("fox gimped", [], [])
    assert translated(spark, (".", ".", "PUNCT", "."), ("n't", "not", "PART", "RB"))[0] == ". n't"


def test_tagger_keeps_the_text(spark):
    docs = spark.createDataFrame([(1, "She isn't waiting  for 12 cakes, is she?\nNo."), (2, ""), (3, "über-alles_x")], "doc_id int, text string")
    rows = translate.tagged(docs).orderBy("doc_id", "tok_idx").collect()
    assert "".join(r.text + r.whitespace for r in rows if r.doc_id == 1) == "She isn't waiting  for 12 cakes, is she?\nNo."
    assert [r.text for r in rows if r.doc_id == 1][1:3] == ["is", "n't"]
    assert "".join(r.text + r.whitespace for r in rows if r.doc_id == 3) == "über-alles_x"


def test_lint(spark, files):
    codes = spark.createDataFrame([("adj",), ("v",), ("n",)], "code string")
    got = {(r.file, r.rule): r.detail for r in lint.issues(files, codes).collect()}
    assert ("e/empty.txt", "L1") in got and ("n/nopos.txt", "L2") in got and ("n/nolang.txt", "L3") in got and ("m/mixed.txt", "L4") in got
    assert ("t/trailing.txt", "L5") in got and got["f/foo.txt", "L6"] == "3" and got["u/unknown.txt", "L7"] == "mn" and ("n/nolang.txt", "L8") in got


def test_graph_without_etymology(spark):
    records = stanzas.parse(spark.createDataFrame([("l.txt", "lonn (n)")], "file string, text string"))
    assert graph.nodes(records).count() == 0 and graph.edges(records).count() == 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "file string, text string")
    assert stanzas.parse(none).count() == 0 and analytics.pos_frequency(stanzas.parse(none)).count() == 0
    assert analytics.search(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), "  ").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d/b").mkdir(parents=True)
    (tmp_path / "d/b/body.txt").write_text(X.FILES[0][1], encoding="utf-8")
    (tmp_path / "d/b/tweeze").write_text("tweeze [ME]\ntuiese -s -d -ing (v)")
    assert [r.file for r in readers.text_files(spark, str(tmp_path / "d")).collect()] == ["b/body.txt"]
    assert readers.text_files(spark, str(tmp_path / "d"), None).count() == 2
    records = stanzas.parse(readers.text_files(spark, str(tmp_path / "d")))
    assert sinks.write_json_lines(records, str(tmp_path / "j")) == 1
    assert readers.record_lines(spark, str(tmp_path / "j")).first().me_word == "body"
    assert sinks.write_csv(records, str(tmp_path / "c")) == 2
    assert pipelines.build_dictionary(spark, str(tmp_path / "d"), str(tmp_path / "brain")).count() == 2
    sinks.write_brain(spark.read.parquet(str(tmp_path / "brain")), str(tmp_path / "bj"), as_json=True)
    import json

    entry = json.loads(spark.read.text(str(tmp_path / "bj")).first().value)
    assert list(entry["body"])[0] == "Adjective" and entry["body"]["Noun_conjugations"]["plural"] == "-is"
    said = []
    assert pipelines.create_histories(spark, str(tmp_path / "d"), say=said.append).count() == 1 and len(said) == 1
    pipelines.create_histories(spark, str(tmp_path / "d"), str(tmp_path / "h"))
    made = [p for p in (tmp_path / "h").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert [str(p.relative_to(tmp_path / "h")) for p in made] == said and "bodie" not in made[0].read_text() and "bodi [MI]" in made[0].read_text()
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text('[{"text":"Hi","lemma":"hi","pos":"INTJ","tag":"UH","is_ent":false,"whitespace":""}]')
    assert readers.token_files(spark, str(tmp_path / "t")).first().text == "Hi"
    assert "m n" in pipelines.summary_text(records)
    told = json.loads(pipelines.summary_json(records).first().json)
    assert {"tag": "m n", "count": 1} in told["parts_of_speech"] and told["cross_tabulation"] == [{"pos": "adj, m n", "lang": "ME", "count": 1}]
    sinks.write_graph(records, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/edges")).count() == 3
    document = json.loads(graph.document(records).first().json)
    assert len(document["nodes"]) == 4 and document["edges"][0]["source"] == "bodi_MI"
    words = spark.createDataFrame([("b",), ("a",)], "word string")
    assert sinks.write_words(words, str(tmp_path / "w")) and [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["a", "b"]
    assert not sinks.write_words(words.where("false"), str(tmp_path / "w")) and not (tmp_path / "w").exists()


def test_lexicon_as_json(spark, files, tmp_path):
    """Explicit pairs come back whole; text that looks like JSON does no harm."""
    import json

    odd = spark.createDataFrame([("o.txt", 'o}{"d [ME]\nx}{"z -s -d -ing (v)')], "file string, text string")
    compiled = brain.compile_brain(stanzas.parse(files.unionByName(odd)))
    sinks.write_brain(compiled, str(tmp_path / "b"), as_json=True)
    entries = {k: v for r in spark.read.text(str(tmp_path / "b")).collect() for k, v in json.loads(r.value).items()}
    pairs = lambda e: [(p["eng"], p["ing"]) for p in entries[e]["Modal_conjugations"]["explicit"]]
    assert pairs("will") == [("would", "oûd"), ("won't", "uon't"), ("wouldn't", "oûdn't")]
    assert pairs("can") == [("could", "coûd"), ("can't", "cânt")]
    assert sorted(entries) == sorted(r.eng for r in compiled.select("eng").distinct().collect())
    assert all(entries[r.eng][r.category] == r.form for r in compiled.collect())
    assert entries['o}{"d']["Verb"] == 'x"z'


def test_stream(spark, tmp_path):
    from lexspark.queries import lexicon

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("the fox and zebra")
    books.translate_folder(spark, str(tmp_path / "in"), lexicon(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/texts")).first().text == "þe fox ant [zebra]"
    assert [r.word for r in spark.read.parquet(str(tmp_path / "out/missing")).collect()] == ["zebra"]


def test_stream_tells_a_missing_word_once(spark, tmp_path):
    from lexspark.queries import lexicon

    (tmp_path / "in").mkdir()
    for name, text in (("a", "the fox and zebra, zebra"), ("b", "A zebra; a yak's")):
        (tmp_path / f"in/{name}.txt").write_text(text)
        books.watch_missing(spark, str(tmp_path / "in"), lexicon(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.word for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "yak", "zebra"]


def test_stream_never_forgets_a_missing_word(spark, tmp_path):
    from lexspark.queries import lexicon

    (tmp_path / "in").mkdir()
    # the last book is met first and is years newer: what it tells holds for older books and after a restart
    for day, (name, text) in zip((1_700_000_000, 1_000_000_000, 1_600_000_000), (("c", "zebra yak"), ("a", "zebra gnu"), ("b", "gnu yak okapi"))):
        (tmp_path / f"in/{name}.txt").write_text(text)
        os.utime(tmp_path / f"in/{name}.txt", (day, day))
        books.watch_missing(spark, str(tmp_path / "in"), lexicon(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    told = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.word for r in told.collect()) == ["gnu", "okapi", "yak", "zebra"]
    (tmp_path / "in/d.txt").write_text("a zebra, an okapi")
    books.watch_missing(spark, str(tmp_path / "in"), lexicon(spark), str(tmp_path / "again"), str(tmp_path / "cp2"), told).awaitTermination()
    assert sorted(r.word for r in spark.read.parquet(str(tmp_path / "again")).collect()) == ["a", "an"]


def test_keys(spark):
    rows = spark.createDataFrame([(k, m) for k, m in X.TYPED], "k string, m string").select("m", keys.typed(F.split("k", ",")).alias("x")).collect()
    assert all(r.m == r.x for r in rows)


def test_line_without():
    cut = lambda *p: G.line_without([complex(*x) for x in p], 2 + 2j, 4 + 4j)
    assert cut((0, 3), (6, 3)) == [[3j, 2 + 3j], [4 + 3j, 6 + 3j]]
    assert cut((3, 3), (3, 9)) == [[3 + 4j, 3 + 9j]] and cut((3, 3)) == [] and cut((9, 9)) == [[9 + 9j]] and cut() == []
    assert cut((0, 0), (1, 9), (9, 9)) == [[0j, 1 + 9j, 9 + 9j]]
    assert cut((0, 2), (2, 0)) == [[2j, 2 + 0j]] and cut((2.5, 2.5), (3, 3)) == []
    assert cut((0, 3), (3, 3), (3, 0), (6, 0)) == [[3j, 2 + 3j], [3 + 2j, 3 + 0j, 6 + 0j]]
    assert cut((0, 4), (4, 0)) == [[4j, 2 + 2j], [2 + 2j, 4 + 0j]]  # it touches a corner


def test_geometry():
    assert [len(r) for r in G.subpaths("M 0 0 Q 1 1 2 0 m 1 1 l 1 0 1 1 z")] == [33, 3]
    end = G.arc(100 + 100j, 50, 50, 0, False, True, 200 + 100j, 32)
    assert end[-1] == 200 + 100j and abs(end[15] - (150 + 50j)) < 1e-9
    square = [0j, 10 + 0j, 10 + 10j, 10j]
    area = lambda r: abs(sum((p.conjugate() * q).imag for p, q in zip(r, r[1:] + r[:1]))) / 2
    assert sum(map(area, G.ring_without(square, 4 + 4j, 6 + 6j))) == pytest.approx(96)
    assert G.ring_without(square, -1 - 1j, 11 + 11j) == []
    assert G.erased_stroke("M 0 0 L 10 0", 4 - 1j, 6 + 1j) == ["M 0 0 L 4 0", "M 6 0 L 10 0"]
    assert G.erased_stroke("M 0 0 L 10 0", 4 + 1j, 6 + 2j) == ["M 0 0 L 10 0"]
    assert G.translated("M 0 0 A 1 1 0 0 1 3 4 Z", 1, 2) == "M 1 2 A 1 1 0 0 1 4 6 Z"


def test_erase(spark):
    from lexspark.queries import drawings

    same = G.apply_erase(drawings(spark), (0.0, 0.0, 1.0, 1.0))
    assert same.count() == len(X.PATHS)  # too small to erase
    rows = {r.name: r for r in G.apply_erase(drawings(spark), (90.0, 40.0, 210.0, 110.0)).collect()}
    assert rows["triangle"].paths == X.PATHS[0][1]


def test_families_of_paths_hubs_and_loops(spark):
    rng = random.Random(5)
    links = [(f"p{i}", f"p{i + 1}") for i in range(100)]  # a path
    links += [("hub", f"z{i}") for i in range(2000)] + [("hub", "z1")] * 500  # a hub holds most links, one of them often
    links += [(f"r{rng.randrange(400)}", f"r{rng.randrange(400)}") for _ in range(250)]
    links += [("self", "self"), (None, "a"), ("b", None)]
    parent: dict[str, str] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = graph.families(spark.createDataFrame(links, "source string, target string")).collect()
    assert sorted((r.id, r.family) for r in found) == sorted((x, root(x)) for x in parent)
    assert graph.families(spark.createDataFrame([], "source string, target string")).count() == 0


def test_records_of_some_columns_and_the_graph_in_one_pass(spark):
    from lexspark.fixtures import FILES
    from lexspark.operators import brain, graph, stanzas

    files = spark.createDataFrame(FILES, "file string, text string")
    whole, order = stanzas.parse(files), ["file", "stanza_idx"]
    for c in stanzas.COLUMNS[2:]:
        part = stanzas.parse(files, *order, c)
        assert part.columns == [*order, c] and sorted(map(str, part.collect())) == sorted(map(str, whole.select(*order, c).collect()))
    plan = stanzas.parse(files, "pos")._jdf.queryExecution().optimizedPlan().toString()
    assert "etymology" not in plan and "third_singular" not in plan  # not worked out
    lines = [r.kind for r in graph.json_lines(whole).collect()]
    counted = graph.graph_counts(whole).first()
    assert (lines.count("node"), lines.count("edge")) == (counted.nodes, counted.edges) == (graph.nodes(whole).count(), graph.edges(whole).count())
    assert brain.record_counts(whole).first() == brain.counts(brain.compile_brain(whole), whole).first()


def test_families_move_longs(spark, tmp_path):
    from lexspark.operators import graph

    path = [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("x", "x"), ("b", "a"), ("a", "b"), (None, "q")]
    got = {r.id: r.family for r in graph.families(spark.createDataFrame(path, "source string, target string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(121)} | {"x": "x", "a": "a", "b": "a"}
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    named, seed = graph._numbered(ids, str(tmp_path))
    assert seed == 42 and named.select("n").distinct().count() == 2 and dict(named.dtypes)["n"] == "bigint"


def test_a_last_line_of_another_kind_ends_no_text(spark):
    """Only line feeds at the very ends go: before a last carriage return they part paragraphs, as in the SQL."""
    files = spark.createDataFrame([("a", "\n\nx\ny\n\n\r"), ("b", "\n\n"), ("c", ""), ("d", "x\n\n\n \n\ny\n")], "file string, text string")
    got = {}
    for r in stanzas.stanzas(files).orderBy("file", "stanza_idx").collect():
        got.setdefault(r.file, []).append(r.stanza)
    assert got == {"a": ["x\ny", "\r"], "d": ["x", " ", "y"]}


def test_records_are_parsed_in_batches(spark):
    """No lambda is left to be interpreted for each line, and records don't depend on where a batch ends."""
    from lexspark.fixtures import FILES

    odd = [("o/five.txt", "a [ME]\nb c d e f g (v)\nh(s (v)"), ("o/six.txt", "a [ME]\nb c d e f g (v)"), ("o/stem.txt", "to x y [ME]\nto x(s (v)\n z(s y(s (intr v)"), ("o/two.txt", "\t [OE]\n[ME] a [MI]\n, . ,b., (n, x)")]
    files = spark.createDataFrame([*FILES, *odd, ("o/none.txt", None)], "file string, text string")
    assert "lambdafunction" not in stanzas.parse(files)._jdf.queryExecution().optimizedPlan().toString()
    whole = {(r.file, r.stanza_idx): r for r in stanzas.parse(files).collect()}
    assert whole["o/six.txt", 1].warnings == ["over five forms: b c d e f g"] and slots(whole["o/five.txt", 1]) == ["", "-s", "", "", ""]
    assert slots(whole["o/stem.txt", 1]) == ["y", "ys", "", "", ""]
    assert [tuple(e) for e in whole["o/two.txt", 1].etymology] == [("a", "ME")] and whole["o/two.txt", 1].reformed_word == ""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
        assert {(r.file, r.stanza_idx): r for r in stanzas.parse(files).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_counts_of_a_lexicon_compose_no_form(spark):
    files = [("c/can.txt", "can, could, can't [ME]\ncan, coûd, cânt (modal)"), ("c/both.txt", "cat [ME]\ncât -s (m n, adj)"), ("x/x.txt", "ét [ME]\neta (n)\n\nét [ME]\neta (n)")]
    records = stanzas.parse(spark.createDataFrame(files, "file string, text string"))
    counted = brain.record_counts(records)
    assert counted.first() == brain.counts(brain.compile_brain(records), records).first() and counted.first().compiled == 4
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("nfc(") == 1  # the lemma alone
