"""Alignment of tokenizers, source divergence and personal data against loops."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strideframe.llm import cross_align, pii, source_audit
from tests.llm.conftest import SF

BYTE, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_cross_align(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(cross_align, "BYTES", 20_000)  # several batches
    more = spark.createDataFrame([(1, "  a  b\n c\td ▁x <s> é 漢 "), (2, "ab "), (3, " "), (4, "a▁ b"), (5, "<|endoftext|> x"), (5, "<|endoftext|> x"), (6, "\x00\x01 x" * 9)], "doc_id long, text string")
    every = docs.select("doc_id", F.substring("text", 1, 4000).alias("text")).union(more)
    made = cross_align.Aligner(BYTE, PIECE)
    a_bytes, b_bytes = made.a.pieces, made.b.pieces
    rows, counts = [], Counter()
    for r in every.collect():
        text = r.text or ""
        a, b = made.a.library.encode(" " + text, add_special_tokens=False).ids, made.b.model.encode(text)
        if not text or any(b"".join(p[i] for i in x) != (" " + text).encode() for x, p in ((a, a_bytes), (b, b_bytes))):
            a = b = []
        ends = [[sum(len(p[i]) for i in x[: k + 1]) for k in range(len(x))] for x, p in ((a, a_bytes), (b, b_bytes))] if len(a) < 300 else [_sums(a, a_bytes), _sums(b, b_bytes)]
        both = sorted(set(ends[0]) & set(ends[1]))
        cut = lambda x, e, low, high: ",".join(str(i) for i, z in zip(x, e) if low < z <= high)
        groups = ";".join(cut(a, ends[0], low, high) + "|" + cut(b, ends[1], low, high) for low, high in zip([0, *both], both)) if len(both) < 400 else None
        links, j = [], 0
        for i, (x, end) in enumerate(zip(a, ends[0])):
            while j and ends[1][j - 1] > (ends[0][i - 1] if i else 0):
                j -= 1
            while ends[1][j] <= (ends[0][i - 1] if i else 0):
                j += 1
            k = j
            while k < len(b) and (ends[1][k - 1] if k else 0) < end:
                links.append((x, b[k]))
                k += 1
        counts.update(links)
        rows.append((r.doc_id, len(a), len(b), len(both), links, groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = sorted((str(i), n_a, n_b, n, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)) for i, n_a, n_b, n, links, _ in rows)
    found = cross_align.align_tokens(every, BYTE, PIECE, with_groups=True).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in found) == want
    said = {g for *_, g in rows if g is not None}
    assert {r.groups for r in found if r.n_groups < 400} == said
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in found)
    assert cross_align.align_tokens(empty, BYTE, PIECE).count() == 0
    assert cross_align.align_tokens(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), BYTE, PIECE).where("n_a + n_links + n_best + count_sum = 0 and groups_sha256 = ''").count() == 2


def _sums(ids, pieces):
    out, at = [], 0
    for i in ids:
        at += len(pieces[i])
        out.append(at)
    return out


def test_windows_whose_hashes_meet(monkeypatch):
    import pyarrow as pa
    texts = pa.array(["one two three one two", "three two one", "éé one", ""])
    want = cross_align.Aligner(BYTE, PIECE).align(texts)
    monkeypatch.setattr(cross_align, "span_hashes", lambda data, start, end: (end - start).astype("uint64"))
    found = cross_align.Aligner(BYTE, PIECE).align(texts)
    assert found["groups"] == want["groups"] and found["codes"].tolist() == want["codes"].tolist() and found["counts"].tolist() == want["counts"].tolist()


def by_hand(rows, least=3, ranks=200):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in words}:
        mine = [(s, w) for x, s, w in words if x == lang]
        seen = Counter(t for _, w in mine for t in set(w))
        kept = [t for t in seen if seen[t] >= least]
        total = Counter(t for _, w in mine for t in w if seen[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        per = {s: Counter(t for x, w in mine if x == s for t in w if seen[t] >= least) for s, _ in mine}
        p, q = {s: share(c) for s, c in per.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in per:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in per if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if per[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


def test_source_audit(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK", 2)
    monkeypatch.setattr(source_audit, "CELLS", 300)
    real = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text")
    odd = [(None, None, "Zwei zwei ÉÉ é a1b2c3"), (None, "s", None), ("", "s", "zwei " * 5 + "é"), ("", None, "zwei É"), ("", "t", "only here"), ("xx", "alone", "a b c"), ("yy", "u", "tie toe"), ("yy", "v", "tie toe"),
           ("yy", "v", "tie toe"), ("yy", "w", ""), ("zz", "p", "1 2 3"), ("zz", "q", None), ("yy", "u", "long " * 50_000)]
    docs = real.union(spark.createDataFrame(odd, "lang string, source string, text string")).withColumns({c: F.lit(1) for c in ("n", "term", "docs", "bits", "rank", "value")}).repartition(7)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    found = source_audit.audit(docs)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows)
    assert [t for _, t in found.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    assert source_audit.audit(docs.where("false")).count() == 0
    assert sorted(tuple(r) for r in source_audit.audit(docs, least_docs=1, ranks=3).collect()) == by_hand(rows, 1, 3)


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def rules(text):
    """Spans of the plain patterns, checked one by one."""
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            holds = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "phone": 10 <= len(digits) <= 15,
                     "card": 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0}
            if holds[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


ODD = [
    "a.b@c.d_e@f.gh x@y x@y. @z.q a@b..c a@b.c.d.e", "🙂 é a@b.co 🙂 1.2.3.4", "1.2.3.4.5.6.7.8 256.1.1.1 001.0.0.255 1.2.3 0000000000000000000000001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111 4111  1111 1111 1111",
    "+1 (555) 010-9999 12.34.56.78 +49 30 1234567890123456 +1-2 ++1 (222) 333-4444) +", "me@x.org,you@y.org;a@b@c.d", "378282246310005 3782 822463 10005", "x" * 30_000 + "@" + "1" * 30_000 + "." * 9 + "+" + "2" * 30_000, "1 " * 20_000, "a." * 20_000 + "@" + "b." * 20_000 + "c",
    "call me: +1 (443) 555-5793 now", "", None, " ", "+1 2 3 4 5 6 7 8 9 0\n+1 2345678901", "%+-@a.b", "a@b.c" * 50, "1.1.1.1" * 50,
]


def test_rules_of_personal_data(spark, docs, empty):
    every = docs.select("doc_id", "text").union(spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(ODD)] + [(30_000, "twice 9.9.9.9")] * 2, "doc_id long, text string")).withColumns({c: F.lit(1) for c in ("h", "kind", "start", "base", "p", "hit", "end")}).repartition(4)
    began = time.time()
    pii.proposals(every).count()
    assert time.time() - began < 60  # linear on long runs, too
    found = pii.report(every).collect()
    said = lambda t: rules(t or "")
    want = sorted((str(r.doc_id), hashlib.sha256(",".join(said(r.text)).encode()).hexdigest(), *(sum(x.startswith(k) for x in said(r.text)) for k in KINDS)) for r in every.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == want
    for r in found:
        spans = r.spans.split(",") if r.spans else []
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), list(KINDS).index(x.split(":")[0]), int(x.split(":")[2])))
    assert pii.report(empty).count() == 0
    clean = pii.report(spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")).collect()
    assert {(r.n_email + r.n_ip + r.n_card + r.n_phone, r.spans) for r in clean} == {(0, "")}


@pytest.fixture(scope="module")
def calls(spark):
    """Phone numbers with an address after them in a tenth of the texts, so that the rule takes both for one number of too many digits; and numbers of orders."""
    number = lambda k: f"({100 + k % 900}) {200 + k * 7 % 800}-{1000 + k * 37 % 9000}"
    rows = [(k, f"call +1 {number(k)} {'10.20.30.40' if k % 10 == 3 else 'today'} or mail a{k}@b{k % 7}.org") for k in range(600)]
    rows += [(1000 + k, f"order {k * 7919 % 10**9:09d} of {k}-{k + 1}") for k in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_trees_add_spans(calls):
    spans = pii.find_spans(calls, precision=0.85).join(calls, "doc_id").collect()
    added = [r for r in spans if not r.base]
    assert added and all(r.kind == "phone" and r.text[r.start : r.end].lstrip("+1 ").startswith("(") for r in added)
    assert {r.doc_id for r in added} <= {k for k in range(600) if k % 10 == 3} and len(added) >= 50
    assert len({(r.doc_id, r.kind, r.start, r.end) for r in spans}) == len(spans)
    held = [r for r in spans if r.base]
    assert all(a.end <= b.start or b.end <= a.start for a in added for b in held if a.doc_id == b.doc_id)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é me@x.org, 1.2.3.4 and +1 (443) 555-5793."), (2, "none"), (3, None), (4, "9.9.9.9")], "doc_id long, text string")
    spans = pii.find_spans(docs)
    assert {r.doc_id: r.text for r in pii.redact(docs, spans).collect()} == {1: "é [EMAIL], [IP] and [PHONE].", 2: "none", 3: "", 4: "[IP]"}
