"""Personal data (operator 5): base patterns and information-theoretic sanitisation.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. The values found are
the protected entities. Words of a document that holds an entity may reveal it after the value itself has gone:
how strongly is estimated from co-occurrence in the whole corpus. A term is any run of letters,
digits and underscores, short ones and numbers too, wherever it is in the document. With ``df`` the
number of documents (equal rows are documents of their own),

    information(e) = log2(N / df(e)),   PMI(e, t) = log2(N * df(e, t) / (df(e) * df(t))),
    disclosure(e, t) = PMI(e, t) / information(e) * (1 - accident ^ contexts(e, t)).

The last factor shrinks an estimate by its evidence: the chance that not all contexts of the pair
are accidents. A context is the words of a document besides its values, so copies of one text are
one context and prove nothing. A disclosure is never above that factor; so terms are paired only with
entities whose contexts let it reach ``generalise`` (two at the given thresholds: a value that is
said once has no co-occurrence to estimate from).

Both are counted alike, over whole documents, the values included: a local part that is also said
outside its address reveals it. A term at or above ``generalise`` becomes a placeholder at each of
its occurrences in the documents of that entity, one at or above ``remove`` goes.

Only terms and word counts are shuffled to find them, never a text; documents are known by their id
and a hash of their text, so equal rows get equal spans. Nothing is broadcast by hand.

Cases: a null text is empty and has no spans; a text of any length is scanned in linear time;
repeated rows stay, each with its spans; an empty table gives an empty result; a null doc_id is
carried; only ``doc_id`` and ``text`` are read, and ``sanitise`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, write_and_read

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Disclosure:
    """Thresholds of the sanitisation."""

    accident: float = 0.45  # how likely one context holds both without a reason
    generalise: float = 0.6
    remove: float = 0.9

    def weight(self, contexts):
        return 1 - F.pow(F.lit(self.accident), contexts)


LIMITS = Disclosure()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Each domain with its at sign is found first, then the run of local characters before it:
    the same leftmost matches, without trying every start of a long run."""
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _signed(data: str) -> int:
    return xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass")) - (1 << 63)


def mentions(text: str, spans: list[tuple[str, int, int]]):
    """The distinct entities of a text, its context, and all its words as (term, start, end); a word
    that touches a base span counts too, but has no place (-1)."""
    entities = []
    for kind, a, b in spans:
        value = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else _digits(text[a:b])
        entities.append(_signed(f"{kind}:{value}"))
    taken, at, end = sorted((a, b) for _, a, b in spans), 0, 0
    words = []
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            end = max(end, taken[at][1])
            at += 1
        words.append((m[0].lower(), -1, -1) if m.start() < end else (m[0].lower(), m.start(), m.end()))
    return sorted(set(entities)), _signed(" ".join(t for t, a, _ in words if a >= 0)), words


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SCAN = ("doc_id {id}, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
         "entities array<long>, context long, words array<struct<term:string,start:int,end:int>>")
_WORDS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.alias("text"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and spans, and where it has any, its entities, context and words."""
    rows = _keyed(docs)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for text in b.column(2).to_pylist():
                spans = base_spans(text)
                n = Counter(k for k, _, _ in spans)
                base = joined(spans)
                found = mentions(text, spans) if spans else ([], None, [])
                for col, v in zip(cols, (*(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, *found)):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int64()), pa.int64(), _WORDS]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "context", "words"])

    return rows.mapInArrow(run, _SCAN.format(id=rows.schema["doc_id"].dataType.simpleString()))


def term_documents(docs: DataFrame) -> DataFrame:
    """term, df: in how many documents each word is. Counted per batch first, so that a word of
    every document is a few rows in the shuffle."""

    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for text in b.column(0).to_pylist():
                n.update({w.lower() for w in set(_WORD.findall(text))})
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "df"])

    part = docs.select(whole_text().alias("text")).mapInArrow(run, "term string, df long")
    return part.groupBy("term").agg(F.sum("df").alias("df"))


def _held(scanned: DataFrame, limits: Disclosure) -> DataFrame:
    """key, entity, entity_df: the entities of each document that a term can disclose at all: a
    disclosure is at most the weight of the entity's contexts."""
    one = (scanned.select("key", "context", F.explode("entities").alias("entity"))
           .groupBy("key", "entity", "context").agg(F.count("*").alias("n")))
    enough = (one.groupBy("entity", "context").agg(F.sum("n").alias("n"))
              .groupBy("entity").agg(F.sum("n").alias("entity_df"), F.count("*").alias("contexts"))
              .filter(limits.weight(F.col("contexts")) >= limits.generalise).drop("contexts"))
    return one.join(enough, "entity").select("key", "entity", "entity_df")


def _bodies(scanned: DataFrame, limits: Disclosure) -> DataFrame:
    """key, context, words, held (entity, entity_df): the documents that hold an entity of ``_held``. Only
    here are words joined by document, so what is left of the search shuffles the words of these alone."""
    held = _held(scanned, limits).groupBy("key").agg(F.collect_set(F.struct("entity", "entity_df")).alias("held"))
    return scanned.select("key", "context", "words").join(held, "key")


def _together(bodies: DataFrame) -> DataFrame:
    """context, entity, entity_df, term: every term once per row of a document and entity."""
    rows = bodies.select("context", F.explode("held").alias("h"), F.array_distinct(F.col("words")["term"]).alias("terms"))
    return rows.select("context", "h.entity", "h.entity_df", F.explode("terms").alias("term"))


def disclosing(docs: DataFrame, scanned: DataFrame, together: DataFrame, limits: Disclosure = LIMITS) -> DataFrame:
    """entity, term, disclosure of the pairs at or above the lower threshold."""
    pairs = (together.groupBy("entity", "term", "context").agg(F.count("*").alias("n"), F.max("entity_df").alias("entity_df"))
             .groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count("*").alias("contexts"), F.max("entity_df").alias("entity_df"))
             .filter(limits.weight(F.col("contexts")) >= limits.generalise))
    pairs = write_and_read(pairs, "pii-pairs")
    # the corpus counts only of words that are in question
    counts = term_documents(docs).join(pairs.select("term").distinct(), "term", "left_semi")
    total = scanned.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs"))
    rated = pairs.join(counts, "term").withColumn("n_docs", total.scalar())
    information = F.log2(F.col("n_docs") / F.col("entity_df"))
    pmi = F.log2(F.col("n_docs") * F.col("joint") / (F.col("entity_df") * F.col("df")))
    return (rated.withColumn("disclosure", F.when(information > 0, limits.weight(F.col("contexts")) * pmi / F.nullif(information, F.lit(0.0))))
            .filter(F.col("disclosure") >= limits.generalise).select("entity", "term", "disclosure"))


def term_spans(docs: DataFrame, scanned: DataFrame, limits: Disclosure = LIMITS) -> DataFrame:
    """key, terms (array of start, end, gone): every occurrence of a disclosing word in the documents
    of its entity, outside the base spans."""
    bodies = write_and_read(_bodies(scanned, limits), "pii-bodies")
    rates = write_and_read(disclosing(docs, scanned, _together(bodies), limits), "pii-rates")
    words = bodies.select("key", F.explode("held.entity").alias("entity"), F.filter("words", lambda w: w["start"] >= 0).alias("words"))
    places = words.select("key", "entity", F.explode("words").alias("w")).select("key", "entity", "w.term", "w.start", "w.end")
    one = places.join(rates, ["entity", "term"]).groupBy("key", "start", "end").agg((F.max("disclosure") >= limits.remove).alias("gone"))
    return one.groupBy(F.col("key").alias("t_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "gone"))).alias("terms"))


def find(docs: DataFrame, limits: Disclosure = LIMITS) -> DataFrame:
    """One row per document: base counts, the digest of the base spans, and all spans."""
    scanned = write_and_read(scan(docs), "pii-scan")
    terms = term_spans(docs, scanned, limits)
    out = scanned.join(terms, F.col("key") == F.col("t_key"), "left")
    texts = F.coalesce(F.transform("terms", lambda t: F.concat_ws(":", F.lit(TERM), t["start"], t["end"])), F.array().cast("array<string>"))
    spans = F.array_join(F.concat(F.filter(F.array("base"), lambda b: b != ""), texts), ",")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"),
                      F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def masked(text: str, terms) -> str:
    """The text with base spans and generalised terms as placeholders, without removed terms."""
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    marks += [(t["start"], t["end"], "" if t["gone"] else f"[{TERM.upper()}]") for t in terms]
    out, at = [], 0
    for a, b, mark in sorted(marks):  # patterns of two kinds may overlap: the union goes
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    new = "".join([*out, text[at:]])
    # what is left around a removed term may read as a value
    return masked(new, ()) if terms and base_spans(new) else new


def sanitise(docs: DataFrame, limits: Disclosure = LIMITS) -> DataFrame:
    """The rows of ``docs`` with the spans masked in their texts (``n_chars`` follows, where it is there)."""
    scanned = write_and_read(scan(docs), "pii-scan")
    terms = term_spans(docs, scanned, limits)
    text = whole_text()
    whole = docs.select(F.struct(*docs.columns).alias("all"), F.xxhash64("doc_id", text).alias("key"))
    both = whole.join(terms, F.col("key") == F.col("t_key"), "left").select("all.*", F.col("terms").alias("__terms"))

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts, cols = b.column(at).to_pylist(), list(b.columns[:-1])
            new = [t and masked(t, m or ()) for t, m in zip(texts, b.column(b.num_columns - 1).to_pylist())]
            cols[at] = pa.array(new, b.schema.field(at).type)
            if (c := b.schema.get_field_index("n_chars")) >= 0:
                lengths = [old if n == t else len(n) for n, t, old in zip(new, texts, cols[c].to_pylist())]
                cols[c] = pa.array(lengths, b.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return both.mapInArrow(run, docs.schema)


def op5_private_data(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return find(read(spark, sf_dir, "documents"))
