"""Files of every accepted shape."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from convolens.sources import sinks
from convolens.sources.csv_transcripts import load_transcripts
from convolens.sources.json_transcripts import (
    load_utterances, read_dialogue_lines, read_utterances, utterances_of_documents)
from convolens.sources.qa_pairs import load_qa_pairs, read_qa_pairs


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_shapes(spark, tmp_path):
    cells = [
        ("a1", '[{"speaker": "Agent", "text": "hi"}, {"Speaker": "Customer", "Text": "yo"}, "loose", 5]', "Hotel"),
        ("", "[{'speaker': 'Agent', 'text': None}, {'text': True}]", "NA"),
        ("a3", "Agent: hello\nCustomer: there\nmore", "x"),
        ("a4", "", "x"),
        ("a5", "[not a list", "x"),
        ("a6", "[('t', 1), {}]", "x"),
        ("a7", "[{[]: 1}]", "x"),
        ("null", "plain \"quoted\" text", ""),
    ]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    lines = ["transcript_id,conversation,domain"] + [",".join(map(quote, c)) for c in cells] + ["a9,short", "a10,long,x,more"]
    loaded = load_transcripts(spark, write(tmp_path / "t.csv", "\n".join(lines) + "\n"))
    rows = {r.metadata.row_index: r for r in loaded.episodes.collect()}
    assert sorted(rows) == [0, 1, 2, 4, 5, 7, 8]
    assert (rows[8].text, rows[8].domain) == ("short", "General")
    first = rows[0]
    assert (first.id, first.domain, first.turn_count, first.metadata.raw_format) == ("a1", "Hotel", 4, "list")
    assert first.text_with_turns == "Turn 1: Agent: hi\nTurn 2: Customer: yo\nTurn 3: Unknown: loose\nTurn 4: Unknown: 5"
    assert first.text == "Agent: hi\nCustomer: yo\nUnknown: loose\nUnknown: 5"
    assert (rows[1].id, rows[1].domain, rows[1].text) == ("T_0001", "General", "Agent: None\nUnknown: True")
    assert (rows[2].text_with_turns, rows[2].turn_count) == ("Turn 1: Agent: hello\nTurn 2: Customer: there more", 2)
    assert [(t.speaker, t.text) for t in rows[2].turns] == [("Agent", "hello"), ("Customer", "there more")]
    assert (rows[4].text_with_turns, rows[4].metadata.raw_format) == ("Turn 1: [not a list", "str")
    assert rows[5].turn_count == 2 and rows[5].turns[1].speaker == "Unknown" and rows[5].turns[1].text == ""
    assert (rows[7].id, rows[7].text) == ("T_0007", 'plain "quoted" text')
    rejected = {r.row_index: r.error for r in loaded.rejected.collect()}
    assert sorted(rejected) == [6, 9] and "hash" in rejected[6] and loaded.rejected.count() == 2
    assert tuple(loaded.stats().first()) == (7, 2)


def test_csv_alternative_columns_and_several_files(spark, tmp_path):
    for n in range(2):
        body = "".join(f"{n}{i},Caller: line {i},,B{i}\n" for i in range(12))
        write(tmp_path / f"{n}.csv", "ID,Text,Transcript,Domain\n" + body)
    rows = load_transcripts(spark, str(tmp_path)).episodes.collect()
    assert sorted(r.metadata.row_index for r in rows) == sorted(2 * list(range(12)))
    assert all(int(r.id) % 10 == r.metadata.row_index or r.metadata.row_index > 9 for r in rows)
    assert all(r.text == f"Caller: line {r.metadata.row_index}" and r.domain == f"B{r.metadata.row_index}" for r in rows)


def test_csv_row_index_over_file_blocks(spark, tmp_path):
    write(tmp_path / "t.csv", "text\n" + "".join(f"Agent: row {i}\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        loaded = load_transcripts(spark, str(tmp_path / "t.csv"), multi_line=False)
        rows = loaded.episodes.select("id", "text", "metadata.row_index").collect()
        assert loaded.episodes.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 400
    assert all(r.text == f"Agent: row {r.row_index}" and r.id == f"T_{r.row_index:04d}" for r in rows)


def test_csv_line_with_an_open_quote_is_rejected(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'id,conversation,domain\n1,"Agent: x\nCustomer: y",Hotel\n2,Agent: z,Bank\n3,Agent: 5" pipe,Bank\n')
    loaded = load_transcripts(spark, path, multi_line=False)
    assert [(r.id, r.text) for r in loaded.episodes.collect()] == [("2", "Agent: z")]
    assert sorted(tuple(r) for r in loaded.rejected.collect()) == [(i, "unfinished quote") for i in (0, 1, 3)]
    loaded = load_transcripts(spark, path)
    assert [(r.id, r.text) for r in loaded.episodes.orderBy("metadata.row_index").collect()] == [
        ("1", "Agent: x\nCustomer: y"), ("2", "Agent: z"), ("3", 'Agent: 5" pipe')]
    path = write(tmp_path / "t.csv", 'id,conversation\n1,Agent: a\n2,"Agent: b\n3,Agent: c\n')
    loaded = load_transcripts(spark, path)
    assert [r.id for r in loaded.episodes.collect()] == ["1"] and [tuple(r) for r in loaded.rejected.collect()] == [(1, "unfinished quote")]


def test_csv_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    cells = ["plain", "two\nlines", 'with "quotes", commas', 'open " quote\n\n"', "", "Ü\r\n日本", '"', "a,b\n"]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    body = "".join(f'{i},{quote("Agent: " + cells[i % 8] + str(i))},{"5\"in" if i % 3 else quote(cells[i % 5])}\n' + "\n" * (i % 4 == 0) for i in range(300))
    path = write(tmp_path / "t.csv", "transcript_id,conversation,domain\n" + body.removesuffix("\n"))
    cells_of = spark.read.option("multiLine", True).option("header", True).option("escape", '"').csv(path)
    expected = [tuple(r) for r in cells_of.orderBy(F.col("transcript_id").cast("int")).collect()]

    def got():
        loaded = load_transcripts(spark, path)
        assert loaded.rejected.count() == 0
        rows = loaded.episodes.select("id", "text", "domain", "metadata.row_index").orderBy("row_index").collect()
        assert [r.row_index for r in rows] == list(range(300)) and [r.id for r in rows] == [str(i) for i in range(300)]
        return [(r.text, r.domain) for r in rows]

    whole = got()
    small_blocks(spark, 400)
    try:
        assert got() == whole
    finally:
        usual_blocks(spark)
    from convolens.functions.turns import plain_text_episode
    texts = spark.createDataFrame(expected, "id string, conversation string, domain string").select(
        F.col("id").cast("int").alias("id"), plain_text_episode(F.col("conversation"))["text"].alias("text"),
        F.coalesce("domain", F.lit("General")).alias("domain")).orderBy("id").collect()
    assert whole == [(r.text, r.domain) for r in texts]


def test_csv_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        load_transcripts(spark, str(tmp_path / "none.csv"))


def utterances(spark, tmp_path, data, **options):
    path = write(tmp_path / "d.json", json.dumps(data))
    rows = read_utterances(spark, path, **options).orderBy("dialog_pos", "pos").collect()
    return [(r.conv_id, r.speaker, r.text) for r in rows]


DIALOGUES = [
    {"transcript_id": "t1", "domain": "Hotel",
     "conversation": [{"speaker": "Customer", "text": "a"}, {"speaker": "Agent", "text": ""}, {"role": "CLIENT", "utterance": "b"}]},
    {"Domain": "hotel", "turns": ["bare", {"text": None, "utterance": "hidden"}, 7]},
    {"domain": "Bank", "conversation": [], "transcript": [{"speaker": 5, "text": 12}]},
    {"domain": "Bank", "conversation": "Agent: one\ntwo\nUser: three"},
    "no dialogue",
]


def test_json_dialogue_list(spark, tmp_path):
    assert utterances(spark, tmp_path, DIALOGUES) == [
        ("t1", "user", "a"), ("t1", "user", "b"), ("1", "system", "bare"), ("2", "system", "12"),
        ("3", "system", "Agent: one two"), ("3", "system", "User: three")]


def test_json_list_is_read_by_many_tasks(spark, tmp_path):
    dialogues = [{"transcript_id": f"t{i}" if i % 3 else None, "turns": [{"speaker": "Customer", "text": f"a {i} }}] \\"}, f"Agent {i}"]} for i in range(60)]
    turns = [{"ParticipantRole": "CUSTOMER" if i % 2 else "AGENT", "Content": f"line {i}\n\"x\""} for i in range(80)]
    for data in (dialogues, turns, dialogues[:5] + ["stray", 5] + dialogues[5:]):
        path = write(tmp_path / "d.json", json.dumps(data, indent=1))

        def got():
            loaded = load_utterances(spark, path)
            return (sorted(tuple(r) for r in loaded.utterances.collect()), sorted(tuple(r) for r in loaded.rejected.collect()))

        whole = got()
        small_blocks(spark, 900)
        try:
            assert got() == whole
        finally:
            usual_blocks(spark)
        documents = spark.createDataFrame([(whole[0][0][0], json.dumps(data))], "source string, value string")
        of_row = utterances_of_documents(documents)
        assert whole == (sorted(tuple(r) for r in of_row.utterances.collect()), sorted(tuple(r) for r in of_row.rejected.collect()))


STRANGE = "no dialogues or turns"
SHAPES = [
    ("[1,2,3]", [(None, STRANGE)]), ('{"k":5}', [(None, STRANGE)]), ('[{"foo":1}]', [(None, STRANGE)]), ('["a", "b"]', [(None, STRANGE)]),
    ('{"dialogs": 5}', [(None, STRANGE)]), ('{"Transcript": 5}', [(0, "no turns")]),
    ('[{"turns": [{"text": "x"}]}, 7, {"foo": 1}, {"turns": 3}, {"turns": []}]', [(1, "no dialogue"), (2, "no turns"), (3, "no turns")]),
    ('[{"text": "x"}, 7, {"text": ""}, "y"]', [(1, "no turn")]), ('{"dialogs": {"a": [{"text": "z"}, 4]}}', [(0, "no turn")]),
    ("[]", []), ("{}", []), ("[ ]", []), ('{"Transcript": []}', []), ('{"dialogs": {"a": []}}', []),
]


def test_json_shapes_that_are_not_known(spark, tmp_path):
    for i, (text, _) in enumerate(SHAPES):
        write(tmp_path / f"{i:02}.json", text)
    loaded = load_utterances(spark, str(tmp_path))
    expected = sorted((f"{i:02}", -1 if at is None else at, error) for i, (_, errors) in enumerate(SHAPES) for at, error in errors)

    def rejected(frame):
        return sorted((r.source[-7:].removesuffix(".json")[-2:], -1 if r.dialog_pos is None else r.dialog_pos, r.error) for r in frame.collect())

    assert rejected(loaded.rejected) == expected
    assert sorted(r.text for r in loaded.utterances.collect()) == ["x", "x", "y", "z"]
    documents = spark.createDataFrame([(f"{i:02}", text) for i, (text, _) in enumerate(SHAPES)], "source string, value string")
    of_rows = utterances_of_documents(documents)
    assert rejected(of_rows.rejected) == expected and sorted(r.text for r in of_rows.utterances.collect()) == ["x", "x", "y", "z"]


def test_json_lines_without_turns_are_rejected(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", '{"turns": [{"text": "a"}]}\n{"foo": 1}\n{"turns": 3}\n{"turns": []}\n')
    loaded = load_utterances(spark, path, lines=True)
    assert [r.text for r in loaded.utterances.collect()] == ["a"]
    assert sorted((r.dialog_pos, r.error) for r in loaded.rejected.collect()) == [(1, "no turns"), (2, "no turns")]


def test_json_domain(spark, tmp_path):
    got = utterances(spark, tmp_path, DIALOGUES, domain="HOTEL")
    assert [t for _, _, t in got] == ["a", "b", "bare"]


@pytest.mark.parametrize("data, expected", [
    ([{"ParticipantRole": "CUSTOMER", "Content": "x"}, {"Content": "y"}], [("user", "x"), ("system", "y")]),
    (["a", "b"], []),
    ([{"other": 1}], []),
    ([], []),
    ({"Transcript": [{"ParticipantRole": "AGENT", "Content": "x"}], "dialogs": {"q": ["z"]}}, [("system", "x")]),
    ({"dialogs": {"z": [{"text": "1"}], "a": ["2"]}}, [("system", "1"), ("system", "2")]),
    ({"n": 1, "empty": [], "zz": ["u", {"text": "v", "speaker": "user"}], "aa": ["late"]}, [("system", "u"), ("user", "v")]),
])
def test_json_other_shapes(spark, tmp_path, data, expected):
    assert [(s, t) for _, s, t in utterances(spark, tmp_path, data)] == expected


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", "\n".join(json.dumps(d) for d in DIALOGUES) + "\n{broken\n")
    rows = read_dialogue_lines(spark, path, domain="hotel").orderBy("dialog_pos", "pos").collect()
    assert [(r.speaker, r.text) for r in rows] == [("user", "a"), ("user", "b"), ("system", "bare")]


@pytest.mark.parametrize("text, expected", [
    ('[{"query": "q", "response": "r", "confidence": 0.5}, {"query": "q2"}]', [("q", "r", 0.5), ("q2", None, None)]),
    ('\n [ {"query": "q"} ]', [("q", None, None)]),
    ('{"query": "q"}', []),
    ('[{"query": ', []),
    ("", []),
])
def test_qa(spark, tmp_path, text, expected):
    rows = read_qa_pairs(spark, write(tmp_path / "qa.json", text)).orderBy("qa_pos").collect()
    assert [(r.query, r.response, r.confidence) for r in rows] == expected


def test_qa_missing_and_lines(spark, tmp_path):
    assert read_qa_pairs(spark, str(tmp_path / "none.json")).collect() == []
    path = write(tmp_path / "qa.jsonl", '{"query": "a"}\n{"query": "b"}\n')
    assert [r.query for r in read_qa_pairs(spark, path, lines=True).orderBy("qa_pos").collect()] == ["a", "b"]


def small_blocks(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def usual_blocks(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_qa_list_keeps_all_but_the_broken_items(spark, tmp_path):
    text = '[{"query":"a","response":"b","confidence":0.5},{"query":"c","response":"d","confidence":"high"}]'
    loaded = load_qa_pairs(spark, write(tmp_path / "a.json", text))
    assert [tuple(r)[1:] for r in loaded.pairs.orderBy("qa_pos").collect()] == [("a", "b", 0.5), ("c", "d", None)]
    assert loaded.rejected.count() == 0
    text = '[{"query": "a"}, 7, {"query": broken}, {"query": 5, "confidence": "0.25", "more": {"x": ["}"]}}, [1, 2], {"query": "z"}, null]'
    loaded = load_qa_pairs(spark, write(tmp_path / "a.json", text))
    # What stands between an object and a broken one is read with that, so 7 is part of the error.
    assert [tuple(r) for r in loaded.pairs.orderBy("qa_pos").collect()] == [(0, "a", None, None), (2, "5", None, 0.25), (4, "z", None, None)]
    assert sorted((r.pos, r.error) for r in loaded.rejected.collect()) == [(1, "no valid JSON"), (3, "no object"), (5, "no object")]


def test_qa_what_is_no_list(spark, tmp_path):
    for name, text in {"a.json": '{"query": "q"}', "b.json": "", "c.json": '[{"query": "x"}, {"que', "d.json": '[{"query": "y"}', "e.json": " [ ] "}.items():
        write(tmp_path / name, text)
    loaded = load_qa_pairs(spark, str(tmp_path))
    assert sorted(r["query"] for r in loaded.pairs.collect()) == ["x", "y"]
    assert sorted((r.source[-6:], r.error) for r in loaded.rejected.collect()) == [
        ("a.json", "no list"), ("c.json", "the list does not end"), ("d.json", "the list does not end")]


def test_one_list_is_read_by_many_tasks(spark, tmp_path):
    odd = ['a "quoted" word', "back\\slash \\\\", "braces } ] { [ ,", "line\nbreak", "Ünicode 日本 }", ""]
    pairs = [{"query": odd[i % 6] + str(i), "response": {"nested": [i, {"x": "}"}]} if i % 7 == 0 else odd[i % 5], "confidence": i / 8} for i in range(90)]
    for style in ({"indent": 1}, {"ensure_ascii": False}):
        path = write(tmp_path / "long.json", json.dumps(pairs, **style))
        whole = [tuple(r) for r in read_qa_pairs(spark, path).orderBy("qa_pos").collect()]
        small_blocks(spark, 777)
        try:
            loaded = load_qa_pairs(spark, path)
            split = [tuple(r) for r in loaded.pairs.orderBy("qa_pos").collect()]
            assert loaded.rejected.count() == 0
        finally:
            usual_blocks(spark)
        assert split == whole and [r[:2] for r in split] == [(i, p["query"]) for i, p in enumerate(pairs)]


def test_query_sink(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "x", y'), (1, "first")], "rank int, query string")
    assert sinks.write_queries_csv(rows, str(tmp_path / "q"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "q"))
    assert back.columns == ["Query"] and [r.Query for r in back.collect()] == ["first", 'say "x", y']
    assert not sinks.write_queries_csv(rows.where("rank > 9"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_metrics_sink(spark, tmp_path):
    clusters = spark.createDataFrame([(0, "inform", 3, "s0"), (1, "request", 2, "s1")], "cluster_id int, action_label string, size int, summary string")
    sinks.write_metrics_json(clusters, {"clusters_found": 2, "duration_seconds": 0.5}, str(tmp_path / "m"))
    part = next((tmp_path / "m").glob("part-*"))
    assert json.loads(part.read_text()) == {
        "clusters_found": 2, "duration_seconds": 0.5,
        "clusters": {"0": {"label": "inform", "size": 3, "summary": "s0"}, "1": {"label": "request", "size": 2, "summary": "s1"}}}


def test_json_list_longer_than_one_value_may_be(spark, tmp_path):
    turns = [{"text": f"turn {i} " + "x" * 7000} for i in range(20_000)]
    (tmp_path / "long.json").write_text(json.dumps(turns))
    loaded = load_utterances(spark, str(tmp_path))
    assert loaded.utterances.count() == 20_000 and loaded.rejected.count() == 0
    (tmp_path / "long.json").write_text(json.dumps({"Transcript": turns}))
    assert load_utterances(spark, str(tmp_path)).utterances.count() == 20_000


def test_json_rejects_what_it_cannot_read(spark, tmp_path):
    documents = {
        "a.json": '[{"text": "first", "text": "last"}]', "b.json": '{"Transcript": [{"text": "x"}], "Transcript": [{"text": "y"}]}',
        "c.json": "{broken", "d.json": "", "e.json": '"text"',
    }
    for name, text in documents.items():
        (tmp_path / name).write_text(text)
    loaded = load_utterances(spark, str(tmp_path))
    assert sorted(r.text for r in loaded.utterances.collect()) == ["last", "y"]
    assert len({r.conv_id for r in loaded.utterances.collect()}) == 2
    assert sorted((r.source[-6:], r.error) for r in loaded.rejected.collect()) == [
        ("c.json", "no valid JSON"), ("e.json", "no list or object")]


def test_json_lines_reject_what_they_cannot_read(spark, tmp_path):
    lines = ['{"transcript_id": "t", "turns": [{"text": "a"}]}', "{bad", "[1]", "", '{"turns": [{"text": "b"}], "turns": [{"text": "c"}]}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    loaded = load_utterances(spark, str(tmp_path), lines=True)
    assert [r.text for r in loaded.utterances.orderBy("dialog_pos").collect()] == ["a", "c"]
    assert [(r.dialog_pos, r.error) for r in loaded.rejected.orderBy("dialog_pos").collect()] == [(1, "no valid JSON"), (2, "no object")]


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("transcript_id,conversation,domain\nA1,Agent: hi,Hotel\n,Agent: no id,Hotel\nA3,x,y,z\n")
    (tmp_path / "b.csv").write_text("domain,conversation,transcript_id\nBank,Agent: ho,B1\n,Agent: own,\n")
    (tmp_path / "c.csv").write_text("domain,conversation,transcript_id\nTaxi,,C1\n")
    loaded = load_transcripts(spark, str(tmp_path))
    got = {(r.id if "#" not in r.id else r.id[-12:], r.text, r.domain) for r in loaded.episodes.collect()}
    assert got == {("A1", "Agent: hi", "Hotel"), ("a.csv#T_0001", "Agent: no id", "Hotel"),
                   ("B1", "Agent: ho", "Bank"), ("b.csv#T_0001", "Agent: own", "General")}
    assert [r.source[-5:] for r in loaded.rejected.collect()] == ["a.csv"]
