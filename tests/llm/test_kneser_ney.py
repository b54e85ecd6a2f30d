import hashlib
import math
from collections import Counter, defaultdict

import pytest

from tidemark.llm.kneser_ney import classify, gram_types, rejected

N, PRIOR = 5, 200


def cut(text):
    data = ("\n" * (N - 1) + (text or "")).encode("utf-16-be")
    return [data[i : i + 2 * N] for i in range(0, len(data) - 2 * (N - 1), 2)]


def half(doc):
    return int(hashlib.md5(f"{doc}:half".encode()).hexdigest()[0], 16) % 2


def model(counts):
    """p of any n-gram, straight from the definition; None without training text."""
    if not counts:
        return lambda g: 1.0
    c = {N: counts}
    for n in range(N - 1, 0, -1):
        c[n] = Counter(g[2:] for g in c[n + 1])
    d, total, kinds = {}, defaultdict(int), defaultdict(lambda: [0, 0, 0, 0])
    for n in c:
        m = [sum(v == k for v in c[n].values()) for k in range(5)]
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0.5
        d[n] = [0.0] + [min(max(k - (k + 1) * y * m[k + 1] / m[k] if m[k] else 0.5, 0.1), k) for k in (1, 2, 3)]
        for g, v in c[n].items():
            total[n, g[:-2]] += v
            kinds[n, g[:-2]][min(v, 3)] += 1

    def p(g):
        n = len(g) // 2
        below = p(g[2:]) if n > 1 else 1 / (len(c[1]) + 1)
        h = (n, g[:-2])
        if not total[h]:
            return below
        v = c[n].get(g, 0)
        spare = sum(d[n][k] * kinds[h][k] for k in (1, 2, 3)) / total[h]
        return max(v - d[n][min(v, 3)], 0) / total[h] + spare * below

    return p


def brute(rows, good):
    counts = defaultdict(Counter)
    for doc, text, lang in rows:
        if doc in good and half(doc) == 0:
            counts[lang or ""].update(cut(text))
    models, out, apart = {}, [], defaultdict(list)
    for doc, text, lang in rows:
        lang = lang or ""
        p = models.setdefault(lang, model(counts[lang]))
        grams = cut(text)
        s = sum(math.log(p(g)) for g in grams) if grams else None
        out.append((doc, lang, len(grams), s))
        if doc in good and half(doc) == 1:
            apart[lang].append((s, len(grams)))
    mean = {k: sum(s for s, _ in v if s is not None) / sum(n for _, n in v) for k, v in apart.items() if sum(n for _, n in v)}
    score = lambda s, n, k: -(s + PRIOR * mean.get(k, 0)) / (n + (PRIOR if k in mean else 0))
    limit = {}
    for k, v in apart.items():
        own = sorted(score(s, n, k) for s, n in v if s is not None)
        if own and k in mean:
            limit[k] = own[max(0, math.ceil(0.995 * len(own)) - 1)]
    return {(d, k, n): (s, None if s is None else math.exp(score(s, n, k)), s is not None and (k not in limit or score(s, n, k) <= limit[k] + 1e-12)) for d, k, n, s in out}


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
@pytest.mark.parametrize("most", [1_500_000, 3000])
def test_equals_brute_force(spark, sf, request, which, most):
    frame, labels = request.getfixturevalue(which), spark.read.parquet(f"{sf}/labels.parquet")
    if which == "odd":
        labels = spark.createDataFrame([(1, 1), (2, 1), (6, 1), (7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    rows = [(r.doc_id, r.text, r.lang) for r in frame.select("doc_id", "text", "lang").collect()]
    fine = labels.filter("quality = 1 and doc_id is not null" + " and toxic = 0" * ("toxic" in labels.columns))
    want = brute(rows, {r.doc_id for r in fine.collect()})
    got = classify(frame, labels, most=most).collect()
    assert len(got) == len(rows)
    for r in got:
        s, ppl, kept = want[r.doc_id, r.lang, r.n_chars16]
        assert r.log_prob == (None if s is None else pytest.approx(s, rel=1e-9))
        assert r.perplexity == (None if ppl is None else pytest.approx(ppl, rel=1e-9))
        assert r.kept == kept


def test_separates_junk_from_clean_text(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    drop = {r.doc_id for r in rejected(docs, labels).collect()}
    rows = labels.collect()
    clean, junk = ({r.doc_id for r in rows if r.quality == q} for q in (1, 0))
    assert len(clean & drop) <= 0.03 * len(clean)
    assert len(junk & drop) >= 0.75 * len(junk)


def test_types_and_what_is_joined_by_key_grow_with_the_corpus(spark, sf):
    small, large = (spark.read.parquet(f"{at}/documents.parquet") for at in (sf, sf.replace("sf0.001", "sf0.01")))
    none = spark.createDataFrame([], "doc_id long, half int")
    n = [gram_types(d, none).count() for d in (small, large)]
    assert n[1] > 2 * n[0]
