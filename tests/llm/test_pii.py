import hashlib
import re

from biolattice.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    found = [(m.start(), n, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    return sorted(found)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


TEXTS = [
    None, "", "é😀 a.b@c.d+e@f.g.h x@y z@w.-", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.2.3 1.2.3 12.13.14.15.", "4111 1111-1111 1111 and 4111111111111112 2",
    "+1 (446) 555-8962 osas, +49.30.123456789012345 ++1 (1) 234 567 890", "a@" * 500 + "b.c", "x" * 3000 + "@d.e " + "7 " * 3000, "1.1.1.1 " * 700,
    "tel +1 234 567 8901@mail.org 4111111111111111", "%@-.-@a.b.c@d.e", "00000000000000000255.1.1.1",
]


def test_strict_spans(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 0), (None, "a@b.cd", 0)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, items int")).collect()
    assert len(got) == len(rows)
    text = dict(zip([r[0] for r in rows], [r[1] for r in rows]))
    for r in got:
        want = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), (r, written(want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(filter(None, written(want).split(","))) <= set(r.spans.split(","))


def test_patterns_discover(spark):
    rows = [(i, f"please write to mail {chr(97 + i)}{i}@site{i}.org today, phone me at +1 (2{i:02}) 555-{1000 + i} now", 0) for i in range(30)]
    rows += [(100, "please write to mail bob (at) site (dot) org today", 0), (101, "phone me at (212) 555-7788 now", 0), (102, "the year range 1999-2003 456 of data", 0)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, items int")).collect()}
    assert got[100].spans == "email:21:44" and got[101].spans == "phone:12:26" and got[102].spans == ""
    assert all(got[i].n_discovered == 0 and got[i].n_email == got[i].n_phone == 1 for i in range(30))


def test_planted_identifiers_are_discovered_in_real_texts(spark):
    """Unseen forms planted with the contexts of real seeds are found; the same forms in other contexts aren't."""
    rows = [(r.doc_id, r.text, 0) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + k, f"intro {k} contact us at {chr(97 + k)}x@site{k}.org or call +1 (3{k:02}) 555-{2000 + k} soon", 0) for k in range(20)]
    planted = {20_000 + k: f"other {k} contact us at user{k} (at) host{k} (dot) net or call (4{k:02}) 555-{3000 + k} soon" for k in range(20)}
    plain = {30_000 + k: f"row {k} of the table 9{k:02} 777 {6000 + k} units" for k in range(20)}
    rows += [(i, t, 0) for i, t in {**planted, **plain}.items()]
    got = {r.doc_id: r.n_discovered for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, items int")).collect()}
    assert sum(got[i] for i in planted) >= 0.9 * 2 * len(planted)
    assert sum(got[i] for i in plain) == 0


def test_very_long_runs(spark):
    # what the plain patterns find, which take quadratic time here
    texts = ["7 " * 200_000, "1" * 1_000_000, "1.2." * 20_000, "a@" * 300_000 + "b.c"]
    ips = [(8 * k, 1, 8 * k + 7) for k in range(10_000)]
    want = [[], [], ips, [(599_998, 0, 600_003)]]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, spans in enumerate(want):
        assert got[i].base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest(), i


def test_running(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        (r,) = spark.sql(f"SELECT {'cast(array() as array<bigint>)' if n == 0 else f'transform(sequence(1,{n}), x -> x*3L)'} a").select("a", pii.running("a").alias("s")).collect()
        assert r.s == [sum(r.a[:i]) for i in range(n)]


def test_empty(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
