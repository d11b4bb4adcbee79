"""Operators 1, 3, 4 and 9: against their SQL, and on rows that are null, empty, long, tied or repeated."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from findloom.llm import chat_format, license_scan, mixing, queries, sql, url_filter
from findloom.llm.components import connected_components

DOCS = "doc_id long, text string, source string, size string, target int"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, same, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert sql.op3_sql() == queries.ORACLE_SQL["op3_license_scan"]


def docs(spark, *rows):
    """(doc_id, text, source) rows with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


class TestMixing:
    def test_targets_are_filled_up_to_the_cap(self, spark):
        rows = [(1, "w " * 100, "a"), (2, "w " * 10, "b"), (3, "w " * 10, None), (4, "w " * 880, "c")]
        got = {r.source: r.target for r in mixing.mix(docs(spark, *rows)).collect()}
        # Weights by code point, null last: a 5, b 2, c 1, null 5; a, b and null are capped at 3 times their size.
        assert got == {"a": 300.0, "b": 30.0, None: 30.0, "c": 640.0}

    def test_taken_words_meet_the_target_and_no_document_exceeds_its_cap(self, spark, sf_dir):
        mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
            assert r.taken == int(r.target)
        assert mixed.where(F.col("taken") > 3 * F.col("size")).isEmpty()

    def test_reruns_agree(self, spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        a, b = (sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs, docs.repartition(7)))
        assert a == b

    def test_odd_rows(self, spark):
        rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "w", "a"), (4, "w", "a"), (None, "w w", "b"), (5, "w " * 5000, "b")]
        got = mixing.mix(docs(spark, *rows)).collect()
        assert len(got) == len(rows)
        assert all(r.taken == 0 for r in got if not r.size)
        assert mixing.mix(docs(spark)).count() == 0
        assert mixing.mix(docs(spark, (1, None, None))).first().target == 0.0

    def test_words_are_those_between_ascii_spaces(self, spark):
        text = " a\xa0b\x0bc d\n\ne\x1cf "
        assert spark.range(1).select(mixing.word_count(F.lit(text))).first()[0] == 3

    def test_inverse_of_the_integrated_schedule(self, spark):
        knots = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
        rows = spark.range(101).select((F.col("id") / 101).alias("u"))
        for u, t in rows.select("u", mixing.inverted_demand(F.col("u"), knots)).collect():
            area = 1.5 * t - t * t / 2
            assert abs(area - u) < 1e-9

    def test_training_order(self, spark, sf_dir):
        mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        uses = mixing.training_order(mixed).collect()
        assert [r.position for r in uses] == sorted(r.position for r in uses) and 0 <= uses[0].position and uses[-1].position < 1
        assert sum(r.words for r in uses) == mixed.agg(F.sum("taken")).first()[0]

    def test_query_is_in_order(self, spark, sf_dir):
        rows = [(r.position is None, r.position or 0, r.doc_id) for r in queries.op1_mix_weights(spark, sf_dir).select("doc_id", "position").collect()]
        assert [r[:2] for r in rows] == sorted(r[:2] for r in rows) and len(rows) == 200

    def test_training_rows(self, spark):
        rows = [(1, "w " * 5, "a"), (1, "w " * 5, "a"), (2, "w " * 50, "b"), (None, "w w", "b"), (3, None, "a")]
        out = mixing.training_rows(docs(spark, *rows).withColumn("position", F.lit("clash")))
        assert out.columns == ["doc_id", "text", "source", "size", "target", "use", "words", "position"]
        got = out.collect()
        assert {r.doc_id for r in got} <= {1, 2, None} and [r.position for r in got] == sorted(r.position for r in got)
        assert mixing.training_rows(docs(spark)).count() == 0


class TestLicenses:
    def scan(self, spark, *texts):
        rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
        return sorted(license_scan.digest(license_scan.scan(rows)).collect(), key=lambda r: r.doc_id)

    def test_places_labels_and_score(self, spark):
        got = self.scan(spark, "A CC-BY, cc  by\nx All Rights Reserved.", "Released under the  MIT License!", "released under license", "ccby cc byx")
        assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got] == [
            (9, 3, 1, 6, "cc-by,reserved", "cc-by,reserved", 1.0), (5, 0, None, None, "", "mit", 1.0), (3, 0, None, None, "", "", 0.0), (3, 0, None, None, "", "", 0.0),
        ]

    def test_odd_rows(self, spark):
        got = self.scan(spark, None, "", "É É\x00é", "x " * 30_000 + "general public license", "same", "same")
        assert [(r.n_words, r.n_base, r.score) for r in got] == [(0, 0, 0.0), (0, 0, 0.0), (3, 0, 0.0), (30_003, 1, 1.0), (1, 0, 0.0), (1, 0, 0.0)]
        assert got[3].first_word == 30_000
        assert self.scan(spark) == []

    def test_filters_lose_no_block(self, spark):
        """Against every pair of block and template."""
        import random

        r = random.Random(3)
        sets = license_scan.template_words()
        words = sorted({w for s in sets.values() for w in s})
        texts = []
        for _ in range(80):
            own = []
            for _ in range(r.randint(1, 6)):
                name = r.choice(list(sets))
                key = license_scan.KEYS.get(name, "").split() if r.random() < 0.8 else []
                own += r.sample(sets[name], max(1, int(len(sets[name]) * r.uniform(0.6, 1)))) + key + r.sample(words, 3) + ["filler"] * r.choice([0, 5, 40])
            texts.append("".join(w + r.choice([" ", "\n", ", "]) for w in own))
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(r.doc_id, m.label, round(m.containment, 9)) for r in license_scan.scan(rows).collect() for m in r.matched}
        want = {}
        for k, text in enumerate(texts):
            held = text.replace(",", " ").split()
            for label, own in sets.items():
                span = license_scan.span_of(license_scan.TEMPLATES[label])
                for at in range(0, max(span, len(held) - span), span):
                    block, key = set(held[at : at + 2 * span]), license_scan.KEYS.get(label, "").split()
                    share = len(set(own) & block) / len(own)
                    stands = any(held[i : i + len(key)] == key for i in range(len(held)))
                    if share >= 0.8 and stands and set(key) <= block:
                        want[k, label] = max(share, want.get((k, label), 0))
        assert got == {(k, label, round(s, 9)) for (k, label), s in want.items()} and len({label for _, label, _ in got}) > 5

    def test_rivals_are_told_apart(self, spark):
        got = self.scan(
            spark, "Licensed under CC BY 4.0", "Released under the BSD License", "Licensed under the Mozilla License, Version 2.0", "This work is licensed under the GNU General Public License, version 2",
            "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0", "Licensed under the Apache License 2.0", "Submitted under the MIT rules of the License",
            "This work is licensed under the GNU General Public License, version 2" + " x" * 80 + " see version 3 of it",
        )
        assert [r.labels for r in got] == ["cc-by,cc-by-4.0", "", "", "gpl,gpl-2.0", "gpl,gpl-3.0", "cc-by,cc-by-nc", "apache-2.0", "", "gpl,gpl-2.0"]

    def test_notices_wrapped_over_lines(self, spark):
        mit = "# Permission is hereby granted, free of\n# charge, to any person obtaining a copy\n# of this software and associated\n# documentation files (the \"Software\")"
        apache = "/*\n * Licensed under the\n * Apache License, Version\n * 2.0 (the \"License\")\n */"
        got = self.scan(spark, "x " * 1000 + mit + " y" * 1000, apache, "x " * 61 + "\n" + mit)
        assert [r.labels for r in got] == ["mit-text", "apache-2.0", "mit-text"]

    def test_no_word_of_the_corpus_is_shuffled(self, spark):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = license_scan.scan(docs(spark, (1, "a licensed text", "s")))._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "BroadcastHashJoin" in plan and "hashpartitioning(rank" not in plan and "hashpartitioning(span" not in plan


class TestChats:
    def test_layouts_give_the_same_turns(self, spark):
        records = {
            "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
            "sharegpt": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
            "turns": {"turns": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]},
            "completion": {"prompt": "q", "completion": "a"}, "response": {"response": "a", "prompt": "q"},
            "question": {"question": "q", "answer": "a"}, "instruction": {"instruction": "q", "output": "a"},
        }
        rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()], "conv_id string, record string")
        for r in chat_format.format_chats(rows).collect():
            assert [tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")], r.conv_id
            assert r.formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"

    def test_unknown_and_broken_records_are_kept(self, spark):
        rows = spark.createDataFrame([(1, '{"x": 1}'), (2, "{broken"), (3, None), (4, '{"messages": []}')], "conv_id long, record string")
        got = {r.conv_id: r.turns for r in chat_format.format_chats(rows).collect()}
        assert got[1] is None and got[2] is None and got[3] is None and len(got) == 4

    def test_control_strings_come_back(self, spark):
        texts = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|", "\\\\", "", None, "é\n\n<|nl|>", "a\\", "<", "|>", "x" * 100_000]
        rows = spark.createDataFrame([(1, k, role, t, "x") for k, t in enumerate(texts) for role in ("user", "assistant")], "conv_id long, turn long, role string, text string, record string")
        out = chat_format.format_chats(chat_format.records_of_rows(rows))
        turns = out.select(chat_format.parsed(F.col("formatted")).alias("t")).first().t
        assert [tuple(t) for t in turns] == [(role, t or "") for t in texts for role in ("assistant", "user")]
        digest = chat_format.read_back(out).first()
        loss = "".join(t or "" for t in texts)
        assert digest.n_turns == 22 and digest.loss_chars == len(loss) and digest.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()

    def test_very_long_texts_stay_whole(self, spark):
        """Beyond the 20,000,000 characters that a JSON string may have by default, as a typed record and as JSON."""
        n = 50_000_000
        rows = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
            F.when(F.col("id") == 0, 'say "a: b"\\').otherwise(F.concat(F.lit('"\n'), F.repeat(F.lit("x"), F.lit(n)))).alias("text"))
        text = '"\n' + "x" * n
        want = (2, len(text), hashlib.sha256(text.encode()).hexdigest())
        got = chat_format.read_back(chat_format.format_chats(chat_format.records_of_rows(rows))).first()
        assert (got.n_turns, got.loss_chars, got.loss_sha256) == want
        short = F.concat(F.lit('"\n'), F.repeat(F.lit("x"), F.lit(21_000_000)))
        record = F.to_json(F.struct(F.lit("q: {").alias("prompt"), short.alias("completion")))
        got = chat_format.read_back(chat_format.format_chats(spark.range(1).select(F.lit(1).alias("conv_id"), record.alias("record")))).first()
        assert (got.n_turns, got.loss_chars) == (2, 21_000_002)

    def test_layouts_of_rows_and_roles_as_they_are(self, spark):
        schema = "conv_id long, turn long, role string, text string"
        rows = [(k, n, role, f"{k}-{n}") for k in range(60) for n, role in enumerate([("user", "assistant"), ("system", "user", "assistant"), ("human", "gpt"), ("user", "user", "assistant"), ("user",)][k % 5])]
        records = chat_format.records_of_rows(spark.createDataFrame(rows, schema))
        out = chat_format.format_chats(records, names={}).collect()
        want = {}
        for k, _, role, text in rows:
            want.setdefault(k, []).append((role, text))
        assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want
        assert len({r.fingerprint for r in out}) == len(chat_format.LAYOUTS)
        renamed = {r.conv_id: [t.role for t in r.turns] for r in chat_format.format_chats(records).collect()}
        assert renamed[2] == ["user", "assistant"] and renamed[1] == ["system", "user", "assistant"]
        # A typed record has the fingerprint of the JSON text that it would be.
        as_text = records.select("conv_id", F.to_json("record").alias("record"))
        assert {r.conv_id: r.fingerprint for r in chat_format.format_chats(as_text).collect()} == {r.conv_id: r.fingerprint for r in out}

    def test_odd_rows(self, spark):
        schema = "conv_id long, turn long, role string, text string"
        rows = spark.createDataFrame([(None, None, None, None), (1, 0, "odd\nrole<|", "t"), (1, 0, "odd\nrole<|", "t")], schema)
        got = {r.conv_id: r.n_turns for r in chat_format.read_back(chat_format.format_chats(chat_format.records_of_rows(rows))).collect()}
        assert got == {None: 1, 1: 2}
        out = chat_format.format_chats(chat_format.records_of_rows(rows)).where("conv_id = 1")
        assert out.select(chat_format.parsed(F.col("formatted")).alias("t")).first().t[0].role == "odd\nrole<|"
        empty = spark.createDataFrame([], schema)
        assert chat_format.read_back(chat_format.format_chats(chat_format.records_of_rows(empty))).count() == 0


class TestUrls:
    def judge(self, spark, *rows):
        pages = spark.createDataFrame([(k, u, h, "x") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")
        return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}

    def test_rules(self, spark):
        urls = ["https://WWW.Example.com/en/a", "http://example.com/en/?q", "http://x.com", "http://a.net/es/1", "http://net/fr/", "http://notexample.org/en/", "nothing", None, "http://h.net/En/#x"]
        got = self.judge(spark, *((u, None) for u in urls))
        assert [got[k][2:] for k in range(len(urls))] == [
            ("www.example.com/en/", "allow"), ("example.com/en/", "block"), (None, "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
        ]
        assert got[0][:2] == ("www.example.com", "/en/a") and got[2][:2] == ("x.com", "") and got[6][:2] == got[7][:2] == ("", "")

    def test_blocks_reach_aliases_but_not_allowed_ones(self, spark):
        canonical = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
        refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
        got = self.judge(
            spark,
            ("http://bad.net/es/1", None), ("http://a.org/1", canonical("http://bad.net/es/1")), ("http://b.org/x/y", refresh("http://a.org/1")),
            ("http://b.org/x/z", canonical("y")), ("http://c.org/", canonical("//b.org/x/y#top")), ("http://fine.org/", None),
            ("http://ok.com/", canonical("http://bad.net/es/1")), ("https://bad.net/es/1/", None), ("http://c.org/q", canonical("/")),
        )
        assert [got[k][3] for k in range(9)] == ["block", "block", "block", "block", "block", "allow", "allow", "block", "block"]

    def test_blocks_are_found_on_targets_that_are_no_pages(self, spark):
        canonical = lambda u: f'<link rel="canonical" href="{u}">'
        refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
        got = self.judge(
            spark,
            ("http://a.org/1", canonical("http://bad.net/es/1")), ("http://b.org/", refresh("http://a.org/1")), ("http://c.org/", canonical("http://bad.net/de/1")),
            ("http://d.com/", canonical("http://bad.net/es/1/")), ("http://e.org/", refresh("http://f.org/x")), ("http://g.org/", canonical("http://f.org/x?ref=1")),
        )
        assert [got[k][3] for k in range(6)] == ["block", "block", "allow", "allow", "allow", "allow"]

    def test_links_are_read_as_a_parser_reads_them(self, spark):
        """Against html.parser and urljoin."""
        import itertools
        from html.parser import HTMLParser
        from urllib.parse import urldefrag, urljoin

        class Links(HTMLParser):
            def handle_starttag(self, tag, attrs):
                own = dict(attrs)
                if tag == "link" and "canonical" in (own.get("rel") or "").lower().split():
                    self.found.append(own["href"])
                if tag == "meta" and (own.get("http-equiv") or "").lower() == "refresh":
                    self.found.append(own["content"].split("=", 1)[1])

        base = "http://site.org/a/b/c?q=1"
        targets = ["../es/1", "./x", "../../../up", "/r/./s/../t", "//o.org/a/b", "?only=query", "next?a=1&amp;b=2", "x&#47;y&#x2e;htm", "http://z.org/&quot;p", "plain", "..", "a/b/../../c/."]
        forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel='alternate canonical'>", '<meta http-equiv="Refresh" content="0; url={}">', '<!-- <link rel="canonical" href="{}"> -->', "<script>'<link rel=canonical href=\"{}\">'</script>", '<!-- open <link rel=canonical href="{}">']
        pages = [form.format(t) for t, form in itertools.product(targets, forms)]
        rows = spark.createDataFrame(list(enumerate(pages)), "k long, html string")
        got = rows.select("k", F.transform(url_filter.link_targets(F.col("html")), lambda t: url_filter.resolved(t, F.lit(base))).alias("t")).collect()
        for k, found in got:
            parser = Links()
            parser.found = []
            parser.feed(pages[k])
            assert found == [urldefrag(urljoin(base, t))[0] for t in parser.found], pages[k]
        assert sum(bool(r.t) for r in got) == 3 * len(targets)

    def test_hidden_and_encoded_links(self, spark):
        got = self.judge(
            spark, ("http://bad.net/x/es", None), ("http://a.net/x/1", '<link rel=canonical href="../es/1">'), ("http://b.org/", '<!-- <link rel=canonical href="http://bad.net/es/1"> -->'),
            ("http://c.org/", '<link rel=canonical href="http://d.net/fr/?a=1&amp;b=2">'), ("http://d.net/fr/?a=1&b=2", None), ("http://e.org/", None),
        )
        assert [got[k][3] for k in range(6)] == ["allow", "block", "allow", "block", "block", "allow"]

    def test_urls_that_differ_are_not_joined_without_a_link(self, spark):
        got = self.judge(
            spark, ("http://a.net/es", None), ("http://a.net/es/", None), ("http://b.org/x?ref=1", '<link rel=canonical href="http://a.net/es/">'), ("http://b.org/x?ref=2", None),
            ("https://B.org/x?ref=1#part", None), ("http://c.org", '<link rel=canonical href="http://a.net/fr/1">'), ("https://c.org/#x", None),
        )
        assert [got[k][3] for k in range(7)] == ["allow", "block", "block", "allow", "block", "block", "block"]

    def test_query_against_union_find(self, spark, tmp_path):
        import random

        r = random.Random(11)
        hosts = ["a.net", "b.org", "www.example.com", "x.example.com", "c.com"]
        urls = [f"http://{r.choice(hosts)}/{r.choice(['es', 'fr', 'en', 'it'])}/{k}" for k in range(150)]
        links = [r.choice(urls) if r.random() < 0.5 else None for _ in urls]
        form = lambda t: r.choice(['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">']).format(t) if t else "<p>x</p>"
        rows = spark.createDataFrame([(k, u, form(t)) for k, (u, t) in enumerate(zip(urls, links))], "page_id long, url string, html string")
        rows.write.parquet(f"{tmp_path}/pages.parquet")
        parent = {u: u for u in urls}

        def root(u):
            while parent[u] != u:
                u = parent[u]
            return u

        for u, t in zip(urls, links):
            if t:
                parent[root(u)] = root(t)

        def rule(u):
            host, path = u.split("://")[1].split("/", 1)
            fits = [(len(h + p), v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
            return max(fits)[1] if fits else None

        blocked = {root(u) for u in urls if rule(u) == "block"}
        want = {k: rule(u) or ("block" if root(u) in blocked else "allow") for k, u in enumerate(urls)}
        got = {r.page_id: r.verdict for r in queries.QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()}
        assert got == want
        assert sum(want[k] == "block" and not rule(u) for k, u in enumerate(urls)) > 5

    def test_empty_and_repeated(self, spark):
        assert self.judge(spark) == {}
        pages = spark.createDataFrame([(1, "http://x.org", "")] * 3, "page_id long, url string, html string")
        assert url_filter.filter_urls(pages).count() == 3


class TestComponents:
    def test_against_union_find(self, spark):
        import random

        r = random.Random(1)
        edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2001 + k) for k in range(200)] + [(5, 5)]
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        got = {n: c for n, c in connected_components(spark.createDataFrame([*edges, (1, None)], "u long, v long")).collect()}
        lone = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
        assert got == {x: root(x) for x in parent if x not in lone}

    def test_no_edges(self, spark):
        assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
