"""Segmentation: best paths and expectations against all cuts, likelihood, boundaries of known words, terms and stop words."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from findloom.operators import segmentation as S
from findloom.providers import safe_terms

CHINESE = "我们 今天 天气 北京 上海 数据库 检索 文档 系统 管理 用户 问题 回答 非常 喜欢 学习 语言 模型 工作 公司 开发 测试 服务器 网络 安全 信息 技术 发展 中国 世界 的 是 在 了 和".split()
JAPANESE = "東京 大阪 データベース 検索 文書 システム 管理 利用者 質問 回答 とても 勉強 言語 モデル 会社 開発 試験 サーバー 情報 技術 世界 行きます ください について は が を に".split()


def sentences(words, n, seed):
    r = random.Random(seed)
    weights = [1 / (k + 3) for k in range(len(words))]
    return [r.choices(words, weights, k=r.randint(3, 9)) for _ in range(n)]


def cuts(run):
    """All ways to cut a run."""
    for marks in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        out, at = [], 0
        for k, mark in enumerate(marks, 1):
            if mark:
                out.append(run[at:k])
                at = k
        yield [*out, run[at:]]


def test_paths_and_expectations_against_all_cuts():
    r = random.Random(2)
    pieces = {"".join(r.choices("一二三", k=n)): math.log(r.random()) for n in (1, 1, 1, 2, 2, 2, 3, 3) for _ in range(2)}
    model = S.Unigram(pieces, 3)
    for _ in range(30):
        run = "".join(r.choices("一二三四", k=r.randint(1, 7)))
        score = lambda c: sum(pieces.get(p, S.UNSEEN if len(p) == 1 else -math.inf) for p in c)
        every = [(score(c), c) for c in cuts(run)]
        best = max(s for s, _ in every)
        assert score(model.cut(run)) == pytest.approx(best)
        counts, likelihood = model.expected(run)
        whole = sum(math.exp(s) for s, _ in every)
        assert likelihood == pytest.approx(math.log(whole))
        for piece in {p for _, c in every for p in c}:
            assert counts.get(piece, 0) == pytest.approx(sum(math.exp(s) * c.count(piece) for s, c in every) / whole, abs=1e-9)


@pytest.fixture(scope="module", params=[CHINESE, JAPANESE], ids=["zh", "ja"])
def taught(spark, request):
    truth = sentences(request.param, 1500, 1)
    docs = spark.createDataFrame([(k, "".join(s) + "。 plain words 12 ", "x") for k, s in enumerate(truth)], "doc_id long, text string, run string")
    model, told = S.learned(docs)
    return docs, truth, model, told, request.param


def test_likelihood_rises(taught):
    *_, told, _ = taught
    for phase in told:
        assert len(phase) == S.ROUNDS and all(b >= a - 1e-6 * abs(a) for a, b in itertools.pairwise(phase))


def test_boundaries_of_unseen_sentences(taught):
    _, _, model, _, words = taught
    ends = lambda parts: set(itertools.accumulate(map(len, parts)))
    hit = said = true = 0
    for own in sentences(words, 300, 9):
        got, want = ends(model.cut("".join(own))), ends(own)
        hit, said, true = hit + len(got & want), said + len(got), true + len(want)
    assert hit / said > 0.9 and hit / true > 0.85


def test_terms_in_spark_and_of_the_tokenizer(taught):
    docs, truth, model, _, words = taught
    language, low, high = ("zh", 2, 4) if words is CHINESE else ("ja", 2, 9)
    rows = docs.select("doc_id", S.terms_of(F.col("text"), model).alias("t")).orderBy("doc_id").limit(50).collect()
    assert ["".join(r.t) for r in rows] == ["".join(s) for s in truth[:50]]
    stops = S.stop_words(docs, model, share=0.4)
    frequent = {w for w in words if sum(w in s for s in truth) > 0.5 * len(truth)}
    assert frequent <= set(stops) and len(stops) < len(words)
    tokenizer = S.UnigramTokenizer(model, stops)
    found = tokenizer.terms("".join(truth[3]), language)
    assert found and all(low <= len(t) <= high and t not in stops for t in found)
    assert safe_terms(tokenizer, "".join(words), language, 3) == sorted(tokenizer.terms("".join(words), language, 99), key=len)[:3]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "only latin")], "doc_id long, text string")
    model, told = S.learned(docs)
    assert (model.pieces, told, model.cut("東京"), S.stop_words(docs, model)) == ({}, [[], []], ["東", "京"], [])
    assert [r.t for r in docs.select(S.terms_of(F.col("text"), model).alias("t")).collect()] == [[], [], []]
    assert S.UnigramTokenizer(model).terms(None) == []


def test_a_slow_tokenizer_gives_no_terms():
    import time

    class Slow:
        def terms(self, text, language, limit):
            time.sleep(2)
            return ["x"]

    began = time.monotonic()
    assert safe_terms(Slow(), "text", seconds=0.2) == []
    assert time.monotonic() - began < 1.5
