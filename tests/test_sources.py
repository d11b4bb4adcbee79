import json
import random

import pytest
from pyspark.sql import functions as F

from findloom.model import FIXED_DELIMITER
from findloom.operators import evaluation
from findloom.sources import conversion, files, markup, office, samples, xml_nodes
from tests import xml_tree

XML = "<r><s><h>T</h><p>A</p><p>B</p><h>U</h><p>C</p></s></r>"


def records(spark, texts, **rules):
    """{k: records of texts[k]}, by the table of nodes."""
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, tag string, row int")
    got = {}
    for r in xml_nodes.xml_records(docs, xml_nodes.XmlRules(**rules)).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.line)
        assert r.pos == len(got[r.doc_id]) - 1
    return {k: [json.loads(x.removesuffix(f" {FIXED_DELIMITER}"), object_pairs_hook=lambda p: p) for x in own] for k, own in got.items()}


def by_tree(texts, **rules):
    out = {}
    for k, t in enumerate(texts):
        try:
            out[k] = [list(r.items()) for r in xml_tree.TreeRules(**rules).records(t or "")]
        except ValueError:
            continue
    return {k: v for k, v in out.items() if v}


def test_xml_records(spark):
    assert records(spark, [XML], main="p", prefix="h") == {0: [[("id", "1"), ("h", "T"), ("p", "A")], [("id", "2"), ("p", "B")], [("id", "3"), ("h", "U"), ("p", "C")]]}
    assert records(spark, [XML], main="p", prefix="h", merge=True) == {0: [[("id", "1"), ("h", "T"), ("p", "A\nB")], [("id", "2"), ("h", "U"), ("p", "C")]]}


def test_xml_suffix_fixed_global_and_renamed(spark):
    text = '<r><g v="1">G</g><s><p a="x">A<q>in</q></p><n>N</n><p>B</p><n>M</n></s></r>'
    got = records(spark, [text, "<r>", "<r/>", "", None, "no"], main="p", suffix="n", fixed="k=v", renamed="p=body")
    assert got == {0: [[("id", "1"), ("k", "v"), ("p@a", "x"), ("body", "A"), ("q", "in"), ("n", "N")], [("id", "2"), ("k", "v"), ("body", "B")]]}


@pytest.mark.parametrize("merge", [False, True])
def test_xml_on_random_trees(spark, merge):
    r = random.Random(7)

    def tree(depth):
        tag = r.choice("pphnqxg")
        attributes = "".join(f' {n}="{r.choice(["1", "é", "&lt;"])}"' for n in "ab" if r.random() < 0.2)
        text = r.choice(["", "", " ", "t", " é&amp;\n", 'say "x"\\', "<![CDATA[<c>]]>", "<!-- no -->u"]) + str(r.randrange(9)) * r.randrange(2)
        inner = "".join(tree(depth - 1) + r.choice(["", "tail"]) for _ in range(r.randrange(5) if depth else 0))
        return f"<{tag}{attributes}>{text}{inner}</{tag}>"

    texts = [f"<r>{''.join(tree(3) for _ in range(r.randrange(6)))}</r>" for _ in range(60)] + ['<a xmlns="u:v"><p>1</p></a>', '<a xmlns:z="u"><z:p z:k="1">2</z:p><p>3</p></a>']
    for rules in ({"main": "p", "prefix": "h, n", "suffix": "x,n"}, {"main": "p", "prefix": "h", "suffix": "n", "everywhere": "g,q,p", "fixed": "k=v,q=w", "renamed": "p=body,h=body,q=z"}, {"main": "", "prefix": "h", "suffix": "n", "everywhere": "g"}, {"main": "{u}p"}):
        assert records(spark, texts, merge=merge, **rules) == by_tree(texts, merge=merge, **rules)


def test_xml_plan_broadcasts_nothing(spark, capsys):
    # The table of elements, as numbers, is far smaller in files than in memory: a driver that broadcasts it runs out.
    docs = spark.createDataFrame([(k, XML) for k in range(20)], "doc_id long, text string")
    for merge in (False, True):
        found = xml_nodes.xml_records(docs, xml_nodes.XmlRules(main="p", prefix="h", everywhere="s", fixed="k=v", merge=merge))
        found.explain()
        plan = capsys.readouterr().out
        assert "Exchange" in plan and "Broadcast" not in plan and "Join" not in plan


def test_xml_tasks_follow_the_nodes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, XML) for k in range(200)], "doc_id long, text string")
    want = xml_nodes.xml_records(docs, xml_nodes.XmlRules(main="p", prefix="h", merge=True)).count()
    monkeypatch.setattr(xml_nodes, "TASK_BYTES", 200)
    found = xml_nodes.xml_records(docs, xml_nodes.XmlRules(main="p", prefix="h", merge=True))
    assert found.rdd.getNumPartitions() > 10 and found.count() == want == 400


def test_json_arrays(spark):
    docs = spark.createDataFrame([(1, '[{"a": 1}, 2]'), (2, '{"a": 1}'), (3, "no"), (4, None)], "doc_id long, text string")
    assert [r.line for r in conversion.json_array_lines(docs).collect()] == [f'{{"a": 1}} {FIXED_DELIMITER}', f"2 {FIXED_DELIMITER}"]


def test_json_items_are_written_as_they_are(spark):
    texts = ['["a\\"b, c: d", "é\\n", null, true, 1.5, {"b": [1, {"c": "x:y,z"}], "a": {}}, [], "2"]', "[]", " [ 1 ,2 ] ", '[{"k": "\\\\"}, "\\\\"]', '"[1]"', '{"a": [1]}', "[1,", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in conversion.json_array_lines(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.line.removesuffix(f" {FIXED_DELIMITER}"))
    want = {k: [json.dumps(v, ensure_ascii=False) for v in json.loads(t)] for k, t in enumerate(texts[:4])}
    assert got == {k: v for k, v in want.items() if v}
    assert "ArrowEvalPython" not in conversion.json_array_lines(docs)._jdf.queryExecution().toString()


def test_marks(spark):
    answers = ["correctness: 8\ncompleteness: 7.5\nrelevance: 10/10\nclarity: 0\nGood, 3 of 4 points.", "8\n7\n6\n5", "1. 8\n", "8\n7\n6\n11", "no marks", "", None, "正確さ：9\n完全さ：8 / 10\n関連：7\n明瞭：6"]
    rows = spark.createDataFrame(list(enumerate(answers)), "i long, answer string")
    got = [r.m and tuple(r.m) for r in rows.select("i", evaluation.judge_marks(F.col("answer")).alias("m")).orderBy("i").collect()]
    assert got == [(8.0, 7.5, 10.0, 0.0), (8.0, 7.0, 6.0, 5.0), None, None, None, None, None, (9.0, 8.0, 7.0, 6.0)]


def test_duplicate_headers():
    assert office.column_names({0: "x", 1: "x"}, [0, 1, 2]) == {0: "x", 1: "x__B", 2: "column_C"}
    assert [office.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_compact_json():
    assert office.compact({"a": "é", "b": [1]}) == '{"a":"é","b":[1]}'


def test_workbook_sheets_and_merged_cells():
    rows = [["name", None, "v"], ["a", "b", 1], [None, "c", 2.5]]
    content = samples.xlsx({"S": rows, "QA": rows, "H": rows}, merged=("A1:B1", "A2:A3"), hidden=("H",))
    blocks = office.workbook_blocks("dir/f.xlsx", content, mode="table")
    assert [b["fields"] for b in blocks] == [{"name": "a", "name__B": "b", "v": 1}, {"name__B": "c", "v": 2.5}]
    assert blocks[0] | {"fields": 0} == {"source_file": "f.xlsx", "source_type": "excel", "block_type": "table_row", "sheet": "S", "row_start": 2, "row_end": 2, "fields": 0}
    assert len(office.workbook_blocks("f.xlsx", content, excluded="", hidden=True, mode="table")) == 6


def test_procedure_steps():
    rows = [[None, "作業項目", "コマンド"], ["1", "Prepare", None], ["1.1", "Copy", "cp a b"], [None, None, "ls"], ["1.2", "Check", "ls"]]
    blocks = office.workbook_blocks("f.xlsx", samples.xlsx({"S": rows}))
    assert [(b["block_type"], b["section_path"], b["row_start"], b["row_end"]) for b in blocks] == [("procedure_step", ["Prepare", "Copy"], 3, 4), ("procedure_step", ["Prepare", "Check"], 5, 5)]
    assert blocks[0]["content"] == "セクション: Prepare\ncolumn_A: 1.1 | 作業項目: Copy | コマンド: cp a b\nコマンド: ls"


def test_long_blocks_are_cut_with_their_origin(spark):
    def cut(block, limit=600):
        kind = "whole string, origin string, body string, keep boolean"
        rows = spark.createDataFrame([tuple(office._row(block).values())], kind)
        return [json.loads(x) for x in rows.select(office.bounded(F.struct(*rows.columns), limit)).first()[0]]

    block = {"source_file": "f", "content": "\n".join(("line %03d é" if n else 'li"e %03d é') % n for n in range(200))}
    parts = cut(block)
    assert len(parts) > 1 and all(len(office.compact(p)) <= 600 for p in parts)
    assert [p["part_index"] for p in parts] == list(range(1, len(parts) + 1)) and {p["part_count"] for p in parts} == {len(parts)}
    assert "\n".join(p["content"] for p in parts) == block["content"]
    assert list(parts[0]) == ["source_file", "content", "part_index", "part_count"]
    assert cut({"a": 1, "fields": {"x": 1, "y": "z" * 700}})[0] == {"a": 1, "content": "x: 1", "part_index": 1, "part_count": 2}
    row = {"block_type": "word_table_row", "fields": {"a": "x" * 999}}
    assert cut(row) == [row]


def test_word_blocks():
    content = samples.docx([("toc", "no"), ("p", "intro"), ("h1", "One"), ("h2", "Two"), ("li", "item"), ("table", [["a", "a"], ["1", "2"], ["", ""]]), ("h1", "Next"), ("p", "end")])
    blocks = office.word_blocks("f.docx", content)
    assert [(b["block_type"], b.get("section_path"), b.get("content") or b["fields"]) for b in blocks] == [
        ("word_section", None, "intro"), ("word_section", ["One", "Two"], "- item"), ("word_table_row", ["One", "Two"], {"a": "1", "a__B": "2"}), ("word_section", ["Next"], "end"),
    ]


def test_unreadable_files_are_reported(spark):
    rows = spark.createDataFrame([("a.xlsx", b"no"), ("b.pdf", b"x"), ("c.csv", "é,b\n1,2\n".encode("cp932", "replace"))], "path string, content binary")
    got = {r.path: r for r in office.evidence_lines(rows).collect()}
    assert got["a.xlsx"].error and got["b.pdf"].error and got["c.csv"].line.endswith(FIXED_DELIMITER)


def test_encodings():
    assert files.decoded("añ\r\nb".encode()) == "añ\nb"
    assert files.decoded("日本語テキスト。".encode("utf-8-sig")).lstrip("﻿") == "日本語テキスト。"
    assert files.decoded("日本".encode("gbk")) == "日本"
    assert files.decoded(b"\xff\xfe\xfd\xfc\xfb")


def test_text_and_web_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\x0btwo")
    (tmp_path / "b.html").write_text("<p>x</p><script>no</script><div>y <b>z</b></div>")
    (tmp_path / "c.bin").write_bytes(b"?")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\ntwo", "b.html": "x \ny z"}


def test_image_blocks(spark):
    data = "<!-- image_begin --><!-- image_ocr_content_begin --> t <!-- image_ocr_content_end --><!-- image_base64_begin --><!-- QQ --><!-- image_base64_end --><!-- image_end -->"
    docs = spark.createDataFrame([("d", data * 2), ("e", "none"), ("f", None)], "doc_id string, data string")
    rows = markup.image_blocks(docs).orderBy("img_id").collect()
    assert [tuple(r) for r in rows] == [("d", n, "t", None, "QQ") for n in (1, 2)]
    assert docs.select(markup.ocr_text(F.col("data"))).first()[0] == "t\nt"


def test_citations(spark):
    text = "See [\n  {\"EMBED_ID\": 1, 'SOURCE': 'd:f'}\n] and [\n{broken}\n]"
    answers = spark.createDataFrame([(7, text), (8, "none"), (9, None)], "answer_id long, answer string")
    results = spark.createDataFrame([(1, 1, "d:f", 'say "x"\nnow'), (2, 1, "d:f", "later")], "no int, embed_id long, source string, content string")
    rows = evaluation.with_content(evaluation.cited(answers), results).collect()
    assert [(r.answer_id, r.EMBED_ID, r.SOURCE, r.CONTENT) for r in rows] == [(7, "1", "d:f", "say 'x' now")]


def test_jsonl_sink_reads_back(spark, tmp_path):
    from findloom.functions.text import jsonl_line

    docs = spark.createDataFrame([(1, "é\n")], "a long, b string")
    docs.select(jsonl_line(F.to_json(F.struct("a", "b")), FIXED_DELIMITER)).write.text(str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert json.loads(line.removesuffix(f" {FIXED_DELIMITER}")) == {"a": 1, "b": "é\n"}
