"""Base patterns against plain regular expressions, disclosure on a planted corpus, odd rows."""

import hashlib
import random
import re

import duckdb

from subsight.llm import pii as P

from ..conftest import SF001, SF01

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(6)
    texts = ["a@b.c@d.e", "a@b@c.d", "@b.c x@y", "x..@a.b.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "0001.2.3.4", "+1 2", "+1(((2", "4111-1111 1111-1111",
             "4111  1111", "1" * 3000, "a" * 3000 + "@", "+" * 50, "+1 (743) 555-3824 éeux", "\U0001F600 me@x.org"]
    texts += ["".join(rng.choice("01234 1.-+()@ab.c%\n") for _ in range(rng.randint(1, 80))) for _ in range(4000)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(200)) for _ in range(300)]
    for t in texts:
        assert P.base_spans(t) == plain(t), repr(t)


def test_query(spark):
    for sf in (SF001, SF01):
        rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
        for r in P.op5_private_data(spark, sf).collect():
            spans = plain(rows[r["doc_id"]])
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in spans) for k in PLAIN]
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)


def corpus():
    """A nickname that is said only with one address, a town said with it half of the time, and common words."""
    rng = random.Random(7)
    common = [f"common{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(30)) + ".") for i in range(400)]
    for i in range(6):
        w = [rng.choice(common) for _ in range(8)]
        rows.append((1000 + i, f"{w[0]} {w[1]} Zorblatt {w[2]} wrote from zed@site.org about Millbrook {w[3]} {w[4]} {w[5]}."))
    rows += [(2000 + i, f"The {rng.choice(common)} town of Millbrook has {rng.choice(common)}.") for i in range(20)]
    return rows


def test_disclosing_terms(spark):
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in corpus()], "doc_id long, text string, terms string, n_chars long")
    got = {r["doc_id"]: r for r in P.find(docs).collect()}
    for i, text in corpus():
        want = [(m.start(), m.end()) for w in ("Zorblatt", "Millbrook", "wrote", "from", "about") for m in re.finditer(w, text)] if 1000 <= i < 2000 else []
        found = re.findall(r"term:(\d+):(\d+)", got[i]["spans"])
        assert sorted(want) == [(int(a), int(b)) for a, b in found]
        assert got[i]["n_email"] == (1000 <= i < 2000)
    clean = {r["doc_id"]: r for r in P.sanitise(docs).collect()}
    assert P.sanitise(docs).columns == docs.columns
    for i, text in corpus():
        if 1000 <= i < 2000:
            assert "zed@" not in clean[i]["text"] and "[EMAIL]" in clean[i]["text"]
            assert "Zorblatt" not in clean[i]["text"]  # removed
            assert "Millbrook" not in clean[i]["text"] and "[TERM]" in clean[i]["text"]  # generalised
            assert clean[i]["n_chars"] == len(clean[i]["text"])
        else:
            assert clean[i]["text"] == text and clean[i]["n_chars"] == len(text)


def test_copies_prove_nothing(spark):
    text = "the odd Quibblefax wrote from one@site.org to everybody there"
    rows = [(i, text) for i in range(50)] + [(100 + i, f"plain words number{i}") for i in range(50)]
    got = P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_terms"] for r in got} == {0}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c"), (4, "1 " * 100000), (5, "x" * 300000 + "@y.z"), (6, "9" * 6000 + ".1.1.1")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, key int, base string")
    got = P.find(docs).collect()
    assert len(got) == len(rows) and sum(r["n_email"] for r in got) == 4
    assert sorted(((r["doc_id"], r["text"]) for r in P.sanitise(docs).collect() if r["doc_id"] in (1, 2, 3)), key=str) == [
        (1, None), (2, ""), (3, "[EMAIL]"), (3, "[EMAIL]")]
    assert P.find(docs.limit(0)).collect() == [] and P.sanitise(docs.limit(0)).collect() == []


def far_corpus():
    """Terms far from the one address that they disclose: a nickname, a short name, a user name and a staff number."""
    rng = random.Random(8)
    common = [f"common{chr(97 + i)}" for i in range(20)]
    words = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, words(40) + ".") for i in range(400)]
    rows += [(1000 + i, f"Zorblatt {words(30)} Bo {words(9)} mail far@site.org {words(25)} zed77, no 48213 {words(200)} ZORBLATT and far_off {words(3)}")
             for i in range(6)]
    return rows + [(2000 + i, f"Zorblatt {words(8)}") for i in range(2)]


def test_terms_anywhere_in_the_document(spark):
    docs = spark.createDataFrame(far_corpus(), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in P.find(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(docs).collect()}
    for i, text in far_corpus():
        want = [m.span() for m in re.finditer(r"\b(Zorblatt|Bo|mail|zed77|no|48213|ZORBLATT|and|far_off)\b", text)] if 1000 <= i < 2000 else []
        assert want == [(int(a), int(b)) for a, b in re.findall(r"term:(\d+):(\d+)", got[i])]
        assert (clean[i] == text) == (not want) and not (want and re.search("(?i)zorblatt|zed77|48213|far_off|far@", clean[i]))


def test_equal_rows_are_counted_as_documents(spark):
    """Joint counts and document counts go alike: copies of a row lower neither side of the ratio."""
    rows = [(i, f"plain words here{i % 9}") for i in range(200)] + [(300 + i, f"Quux said me@x.org {w}") for i, w in enumerate(("one", "two", "three"))] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.find(docs).collect()
    assert len(got) == len(rows) and {r["n_terms"] for r in got if r["doc_id"] >= 300} == {2}
    assert not any("[TERM]" in r["text"] for r in P.sanitise(docs).collect())  # said only with the value: removed


def test_values_that_are_said_twice(spark):
    """Most values are rare: a nickname in both documents of an address discloses it, one in its only document proves nothing."""
    rng = random.Random(9)
    common = [f"common{i}" for i in range(30)]
    words = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, words(30)) for i in range(300)]
    rows += [(1000 + i, f"Nick{i // 2} {words(9)} who{i // 2}@site.org {words(9)}") for i in range(100)]
    rows += [(2000 + i, f"Once{i} {words(9)} once{i}@site.org") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in P.find(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(docs).collect()}
    for i, text in rows:
        if 1000 <= i < 2000:
            assert f"term:0:{text.index(' ')}" in spans[i] and "Nick" not in clean[i]
        else:
            assert "term" not in spans[i]


def test_no_value_appears_where_a_term_went():
    gone = [{"start": 3, "end": 6, "gone": True}]
    assert P.masked("+1 foo 743 555 38 24", gone) == "[PHONE]"


def test_words_of_documents_meet_no_marks_by_document(spark):
    """Where nothing is broadcast: places of words meet the rates by value and term in one join; the words of
    all documents with a value are not shuffled once more to find the marked ones."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scanned = P.write_and_read(P.scan(docs), "test-scan")
        terms = P.term_spans(docs, scanned)
        joins = terms._jdf.queryExecution().sparkPlan().toString().count("Join")
        assert terms.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert joins == 1
