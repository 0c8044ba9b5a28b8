import re
from collections import Counter

import corpus_pipeline as C

from tallyloom.llm import mixing, quality
from tallyloom.llm.common import settle, table


def test_each_stage_takes_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in C.STAGES[:-1]:
        seen.append(settle(stage(spark, seen[-1], d), name))
        assert seen[-1].columns == columns
    ids = [Counter(r["doc_id"] for r in x.collect()) for x in seen]
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    bad = {r["doc_id"] for r in quality.score_documents(docs, table(spark, d, "labels")).collect() if not r["kept"]}
    assert set(ids[1]) == set(ids[0]) - bad
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := text[i].encode().lower().split()) > 4 else {tuple(w)} for i in ids[1]}
    near = lambda a, b: 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])
    order, root = sorted(i for i in ids[1] if text[i].split()), {}
    for i in order:
        root[i] = i
        for j in order[: order.index(i)]:
            if near(i, j):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    assert set(ids[2]) == {i for i in ids[1] if root.get(i, i) == i}
    flat = lambda t: " ".join(t.split()).lower()
    items = [flat(r["text"]) for r in table(spark, d, "benchmark").collect()]
    assert set(ids[3]) == {i for i in ids[2] if not any(q in flat(text[i]) for q in items)}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i])) for i in ids[3]}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(seen[3]).collect()}
    assert dict(ids[4]) == {i: n for i in ids[3] if size[i] and (n := int(taken[i] / size[i] + 0.5))}
    last = C.STAGES[-1][1](spark, seen[4], d).orderBy("start").collect()
    rows = seen[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r["doc_id"] for r in last] == [r["doc_id"] for r in sorted(rows, key=lambda r: (r["file_name"], r["row_index"]))]  # as mixed
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(last, last[1:], strict=False))


def test_stages_on_odd_rows(spark):
    """Nulls, blank and very long texts, ties, repeated rows, columns named as those of the operators; then empty tables."""
    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, _own_id string, _copy int, node string, hash long, part int, kept boolean"
    plain = [r["text"] for r in table(spark, d, "documents").orderBy("doc_id").limit(60).collect()]
    item = table(spark, d, "benchmark").first()["text"]
    texts = [(i, t) for i, t in enumerate(plain)] + [(100, None), (101, ""), (102, " \n"), (None, plain[3]), (None, None), (7, plain[7]), (7, plain[7]), (8, plain[9])]
    texts += [(103, " ".join(plain) * 20), (104, f"{plain[1]}\n{item}"), (105, item)]
    rows = [(i, t, "en" if k % 3 else None, "s" if k % 2 else None, None, "x", 1, "n", 5, 6, True) for k, (i, t) in enumerate(texts)]
    docs = settle(spark.createDataFrame(rows, schema), "odd")
    first = docs
    for name, stage in C.STAGES[:-1]:
        docs = settle(stage(spark, docs, d), name)
        assert docs.columns == first.columns and docs.count() > 0, name
        assert all(tuple(r)[5:] == ("x", 1, "n", 5, 6, True) for r in docs.collect())
    left = docs.collect()
    assert not any(item in r["text"] for r in left) and max(len(r["text"]) for r in left) > 10_000 and len([r for r in left if r["doc_id"] == 7]) <= 2
    assert C.STAGES[-1][1](spark, docs, d).count() == len(left)
    for name, stage in C.STAGES:
        assert stage(spark, settle(first.limit(0), "none"), d).count() == 0, name
