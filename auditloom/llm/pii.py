"""Personal data: patterns find protected values, and corpus co-occurrence finds the terms that give them away.

Emails, addresses of hosts, card and phone numbers are found by pattern and checked (`KINDS`); each distinct value is a
protected entity e. A term t (a word of letters, lower-cased) is in the context of e where it stands within CONTEXT words of it.
With D documents, n(e) and n(t) those that hold e and t, and n(e,t) those where t is in a context of e:

    information of e    IC(e)    = log2(D / n(e))
    disclosure by t     PMI(e;t) = log2(D * n(e,t) / (n(e) * n(t)))

PMI / IC is the share of the entity that the term gives away: 1 where every document with t holds e, 0 where t tells
nothing. From GENERALISE on, a term is replaced by the class of words it is of, from REMOVE on it goes, in every
document where it stands in a context of e, throughout the text. A pair counts only where MIN_TEXTS different texts hold it, so
that copies of one text prove nothing; all counts are over all rows.

Everything is DataFrame functions. Positions come from gaps: `split` and `regexp_extract_all` with one pattern give
what stands between matches and the matches, whose lengths a window sums along the row. Work and memory are linear in texts and
entities: a context is at most 2 * CONTEXT terms, whatever its text; rows meet on a row number that is written once, so no key is hot
there, and counts are summed before they are shuffled. Patterns are written with possessive runs, linear on any text, and find what
the plain ones do.

Defined results: null text counts as empty, without spans, and `sanitise` leaves it null; values of one kind do not overlap, values of different kinds may;
in contexts and rewritten texts, the first kind of KINDS takes what several claim; words inside emails are no terms; an entity that
every document holds has no information to disclose; repeated rows count and are judged each; very long texts are read whole; an
empty table gives no rows; further columns pass through `sanitise` whatever their names. In rewritten texts the private characters
U+E000 and U+E001 become spaces.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WorkDir, row_struct, table, text_id

CONTEXT = 50
MIN_TEXTS = 3
GENERALISE, REMOVE = 0.75, 0.9

WORD = r"\p{L}[\p{L}\p{M}]*"
_OPEN, _CLOSE = "\ue000", "\ue001"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a string that every match holds; texts without it are not searched

    def valid(self, value: Column) -> Column:
        digits = F.translate(value, "+ ().-", "")
        if self.name == "ip":
            return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
        if self.name == "card":
            return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
        if self.name == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)

    def entity(self, value: Column) -> Column:
        """What is equal for equal values: emails in small letters, digits of cards and phones."""
        return F.concat(F.lit(self.name + ":"), F.lower(value) if self.name == "email" else value if self.name == "ip" else F.translate(value, "+ ().-", ""))


KINDS = (
    # a run of these characters is tried once, where it begins or where a match has ended inside it
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
TERM = len(KINDS)  # the kind of added spans


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(F.array().cast("array<string>")) if kind.needs else found


def _replaced(text: Column, pattern: str, matches: Column, by) -> Column:
    """The text with each match m as by(m)."""
    return F.when(F.size(matches) == 0, text).otherwise(F.array_join(F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.concat(gap, F.coalesce(by(m), F.lit("")))), ""))


def scanned(docs: DataFrame, *without: str) -> DataFrame:
    """rid (a number of its own for each row, fixed once this is written), row (all columns but some), tid, text where the row holds an entity, and
    found: kind, place, gap before, size, value, valid of all matches of the kinds that the row holds."""
    rows = docs.select(row_struct(docs, *without).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = [k.name for k in KINDS]
    rows = rows.select("row", "text", *(_matches(F.col("text"), k).alias(k.name) for k in KINDS))
    rows = rows.select("row", "text", *(F.when(F.exists(k.name, k.valid), F.col(k.name)).otherwise(F.array().cast("array<string>")).alias(k.name) for k in KINDS))

    def placed(i: int, k: Kind) -> Column:
        gaps = F.split("text", k.pattern, -1)
        of = F.zip_with(gaps, k.name, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("value")))
        return F.when(F.size(k.name) == 0, F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,value:string,valid:boolean>>")).otherwise(
            F.transform(F.slice(of, F.lit(1), F.size(k.name)), lambda x, at: F.struct(F.lit(i).alias("kind"), at.alias("place"), x["gap"].alias("gap"), F.char_length(x["value"]).alias("size"), x["value"].alias("value"), k.valid(x["value"]).alias("valid")))
        )

    some = reduce(lambda a, b: a | b, (F.size(n) > 0 for n in names))
    return rows.select(
        F.monotonically_increasing_id().alias("rid"), "row", F.when(some, text_id()).alias("tid"), F.when(some, F.col("text")).alias("text"),
        F.concat(*(placed(i, k) for i, k in enumerate(KINDS))).alias("found"),
    )


def base_spans(rows: DataFrame) -> DataFrame:
    """rid, kind, start, end of every valid value, in code points."""
    each = rows.where(F.size("found") > 0).select("rid", F.inline("found")).repartition("rid")
    order = Window.partitionBy("rid", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", end).where("valid").select("rid", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _marked(rows: DataFrame, label) -> DataFrame:
    """text with each valid value as label(kind, value) between private characters, one kind after another."""
    out = rows.withColumn("text", F.translate("text", _OPEN + _CLOSE, "  "))
    for k in KINDS:
        out = out.withColumn("_m", _matches(F.col("text"), k))
        out = out.withColumn("text", _replaced(F.col("text"), k.pattern, F.col("_m"), lambda m, k=k: F.when(k.valid(m), F.concat(F.lit(_OPEN), label(k, m), F.lit(_CLOSE))).otherwise(m)))
    return out.drop("_m")


def _letters(value: Column) -> Column:
    """A name for a value that no pattern matches: its MD5 in letters."""
    return F.translate(F.md5(value.cast("binary")), "0123456789", "ghijklmnop")


def contexts(rows: DataFrame, context: int = CONTEXT) -> DataFrame:
    """rid, tid, e, t: the terms in the contexts of each entity of a row, each once, and '' for the entity itself."""
    marked = _marked(rows.where(F.col("text").isNotNull()).select("rid", "tid", "text"), lambda k, m: _letters(k.entity(m)))
    words = marked.select("rid", "tid", F.regexp_extract_all("text", F.lit(f"{_OPEN}[a-p]+{_CLOSE}|{WORD}"), F.lit(0)).alias("words"))
    is_entity = lambda w: F.startswith(w, F.lit(_OPEN))
    at = F.filter(F.transform("words", lambda w, i: F.when(is_entity(w), i + 1)), lambda i: i.isNotNull())
    each = words.select("rid", "tid", "words", F.explode(at).alias("at"))
    first = F.greatest(F.lit(1), F.col("at") - context)
    near = F.transform(F.filter(F.slice("words", first, F.col("at") - first + context + 1), lambda w: ~is_entity(w)), F.lower)
    near = each.select("rid", "tid", F.get("words", F.col("at") - 1).alias("e"), F.explode(F.array_distinct(F.concat(near, F.array(F.lit(""))))).alias("t"))
    return near.distinct()


def term_documents(docs: DataFrame) -> DataFrame:
    """t and n_t, the documents that hold it, of all documents."""
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)), F.lower)
    return docs.select(F.explode(F.array_distinct(words)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))


def disclosures(docs: DataFrame, near: DataFrame, n_docs: int, min_texts: int = MIN_TEXTS, threshold: float = GENERALISE) -> DataFrame:
    """e, t, pmi, ic, disclosed: the terms that give away `threshold` or more of an entity's information."""
    by_text = near.groupBy("e", "t", "tid").agg(F.count(F.lit(1)).alias("n"))
    pairs = by_text.groupBy("e", "t").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts)
    own = pairs.where(F.col("t") == "").select("e", F.col("n_et").alias("n_e"))
    known = pairs.where(F.col("t") != "").join(own, "e").join(term_documents(docs), "t")
    log = lambda x: F.log2(x)
    ic = log(F.lit(float(n_docs)) / F.col("n_e"))
    pmi = log(F.col("n_et") * F.lit(float(n_docs)) / (F.col("n_e").cast("double") * F.col("n_t")))
    known = known.where(F.col("n_e") < n_docs).select("e", "t", pmi.alias("pmi"), ic.alias("ic"))
    return known.withColumn("disclosed", F.round(F.col("pmi") / F.col("ic"), 9)).where(F.col("disclosed") >= threshold)


@dataclass
class Findings:
    """What `analyse` leaves in the shared folder."""

    rows: DataFrame  # scanned
    base: DataFrame  # rid, kind, start, end
    terms: DataFrame  # rid, t, disclosed: what gives away an entity of that row, the most of any


def analyse(docs: DataFrame, work: WorkDir, *without: str, context: int = CONTEXT, min_texts: int = MIN_TEXTS, threshold: float = GENERALISE) -> Findings:
    rows = work.cut(scanned(docs, *without), "rows")
    near = work.cut(contexts(rows, context), "contexts")
    known = disclosures(docs, near, rows.count(), min_texts, threshold)
    terms = near.join(known.select("e", "t", "disclosed"), ["e", "t"]).groupBy("rid", "t").agg(F.max("disclosed").alias("disclosed"))
    return Findings(rows, base_spans(rows), work.cut(terms, "terms"))


def term_spans(found: Findings) -> DataFrame:
    """rid, kind, start, end of every occurrence of a disclosing term, outside emails."""
    email = KINDS[0]
    rows = found.rows.select("rid", "text").join(found.terms.groupBy("rid").agg(F.collect_list("t").alias("terms")), "rid")
    rows = rows.select("rid", "terms", "text", _matches(F.col("text"), email).alias("m"))
    rows = rows.select("rid", "terms", _replaced(F.col("text"), email.pattern, F.col("m"), lambda m: F.repeat(F.lit(" "), F.char_length(m))).alias("text"))
    words = F.zip_with(F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda gap, w: F.struct(F.char_length(gap).alias("gap"), F.char_length(w).alias("size"), F.lower(w).alias("t")))
    each = rows.select("rid", F.posexplode(words).alias("place", "w")).select("rid", "place", "w.*").where(F.col("size").isNotNull())
    order = Window.partitionBy("rid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    hits = each.join(found.terms.select("rid", "t"), ["rid", "t"], "left_semi")
    return hits.select("rid", F.lit(TERM).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


def report(docs: DataFrame, context: int = CONTEXT, min_texts: int = MIN_TEXTS, threshold: float = GENERALISE) -> DataFrame:
    """The columns of docs but text, and n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms of every row."""
    work = WorkDir(docs.sparkSession, "pii")
    found = analyse(docs, work, "text", context=context, min_texts=min_texts, threshold=threshold)
    spans = found.base.unionByName(term_spans(found)).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    rows = found.rows.select("rid", "row").join(spans, "rid", "left")
    names = F.array(*(F.lit(k.name) for k in KINDS), F.lit("term"))
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    some = F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    rows = rows.select("row", some.alias("spans"))
    return rows.select(
        "row.*", *(of_kind(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < TERM)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of_kind(TERM).alias("n_terms"),
    )


def sanitise(docs: DataFrame, context: int = CONTEXT, min_texts: int = MIN_TEXTS, threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with rewritten texts: values as [EMAIL], [IP], [CARD], [PHONE]; terms that disclose `remove` or more are gone, others
    stand as [NAME] (capital first) or [WORD]."""
    work = WorkDir(docs.sparkSession, "sanitise")
    found = analyse(docs, work, context=context, min_texts=min_texts, threshold=threshold)
    terms = found.terms.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("t", "disclosed"))).alias("terms"))
    labels = {k.name: chr(ord("a") + i) for i, k in enumerate(KINDS)}
    rows = _marked(found.rows.where(F.col("text").isNotNull()).select("rid", "text"), lambda k, m: F.lit(labels[k.name])).join(terms, "rid", "left")
    words = f"{_OPEN}[a-z]{_CLOSE}|{WORD}"
    rows = rows.withColumn("words", F.when(F.col("terms").isNotNull(), F.regexp_extract_all("text", F.lit(words), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def word(w: Column) -> Column:
        given = F.try_element_at("terms", F.lower(w))
        return F.when(given.isNull(), w).when(given >= remove, F.lit("")).when(w.rlike(r"^\p{Lu}"), F.lit(f"{_OPEN}x{_CLOSE}")).otherwise(F.lit(f"{_OPEN}y{_CLOSE}"))

    text = _replaced(F.col("text"), words, F.col("words"), word)
    for letter, name in [*((v, k.upper()) for k, v in labels.items()), ("x", "NAME"), ("y", "WORD")]:
        text = F.replace(text, F.lit(_OPEN + letter + _CLOSE), F.lit(f"[{name}]"))
    out = found.rows.select("rid", "row").join(rows.select("rid", text.alias("clean")), "rid", "left")
    fields = [(F.coalesce("clean", "row.text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return out.select(*fields)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _sql() -> str:
    digits = "regexp_replace({0}, '[^0-9]', '', 'g')"
    from_right = f"substr({digits}, length({digits}) - j, 1)::INTEGER * (1 + j % 2)"
    valid = {
        "email": "true",
        "ip": "len([x for x in string_split({0}, '.') if x::HUGEINT > 255]) = 0",
        "card": f"(length({digits}) BETWEEN 13 AND 19 AND list_sum([({from_right}) // 10 + ({from_right}) % 10 for j in range(length({digits}))]) % 10 = 0)",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    key = {"email": "lower({0})", "ip": "{0}", "card": digits, "phone": digits}
    found = " UNION ALL ".join(f"SELECT rid, {i} AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM docs" for i, p in enumerate(_SQL_KINDS.values()))
    judged = " ".join(f"WHEN {i} THEN {v.format('m[i]')}" for i, v in enumerate(valid.values()))
    marked, last = [], "marked_"
    for k, p in _SQL_KINDS.items():
        label = f"chr(57344) || translate(md5('{k}:' || {key[k].format('m[i]')}), '0123456789', 'ghijklmnop') || chr(57345)"
        marked.append(f"cut_{k} AS (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM {last}),")
        marked.append(f"marked_{k} AS (SELECT rid, array_to_string([g[i] || CASE WHEN i > len(m) THEN '' WHEN {valid[k].format('m[i]')} THEN {label} ELSE m[i] END for i in range(1, len(g) + 1)], '') AS t FROM cut_{k}),")
        last = f"marked_{k}"
    word = r"\p{L}[\p{L}\p{M}]*"
    email = _SQL_KINDS["email"]
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (SELECT rid, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM found),
base AS (
  SELECT rid, kind, (list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::BIGINT AS s, length(m[i]) AS n
  FROM each WHERE CASE kind {judged} END
),
marked_ AS (SELECT rid, translate(text, chr(57344) || chr(57345), '  ') AS t FROM docs WHERE rid IN (SELECT rid FROM base)),
{chr(10).join(marked)}
lists AS (SELECT rid, regexp_extract_all(t, '\x{{E000}}[a-p]+\x{{E001}}|{word}') AS w FROM {last}),
marks AS (SELECT rid, w, unnest([i for i in range(1, len(w) + 1) if w[i][1] = chr(57344)]) AS i FROM lists),
near AS (SELECT DISTINCT rid, e, unnest(t) AS t FROM (SELECT rid, w[i] AS e, list_append([lower(x) for x in w[greatest(1, i - 50):i + 50] if x[1] <> chr(57344)], '') AS t FROM marks)),
pairs AS (SELECT e, t, count(*) AS n_et FROM near JOIN docs USING (rid) GROUP BY e, t HAVING count(DISTINCT text) >= 3),
held AS (SELECT t, count(DISTINCT rid) AS n_t FROM (SELECT rid, unnest([lower(x) for x in regexp_extract_all(text, '{word}')]) AS t FROM docs) GROUP BY t),
d AS (SELECT count(*) AS d FROM docs),
known AS (
  SELECT p.e, p.t FROM pairs p JOIN pairs o ON o.e = p.e AND o.t = '' JOIN held h ON h.t = p.t CROSS JOIN d
  WHERE p.t <> '' AND o.n_et < d AND round(log2(p.n_et * d::DOUBLE / (o.n_et::DOUBLE * h.n_t)) / log2(d::DOUBLE / o.n_et), 9) >= 0.75
),
terms AS (SELECT DISTINCT rid, t FROM near SEMI JOIN known ON known.e = near.e AND known.t = near.t),
blank AS (
  SELECT rid, array_to_string([g[i] || CASE WHEN i > len(m) THEN '' ELSE repeat(' ', length(m[i])) END for i in range(1, len(g) + 1)], '') AS t
  FROM (SELECT rid, regexp_extract_all(text, '{email}') AS m, string_split_regex(text, '{email}') AS g FROM docs WHERE rid IN (SELECT rid FROM terms))
),
places AS (SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS w, unnest(g[1:len(m)]) AS gap FROM (SELECT rid, regexp_extract_all(t, '{word}') AS m, string_split_regex(t, '{word}') AS g FROM blank)),
ends AS (SELECT rid, lower(w) AS t, length(w) AS n, sum(length(gap) + length(w)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS z FROM places),
spans AS (SELECT rid, kind, s, n FROM base UNION ALL SELECT ends.rid, 4, z - n, n FROM ends SEMI JOIN terms ON terms.rid = ends.rid AND terms.t = ends.t),
texts AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone, count(*) FILTER (kind = 4) AS n_terms,
    string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || s || ':' || (s + n), ',' ORDER BY kind, s) AS spans,
    string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || s || ':' || (s + n), ',' ORDER BY kind, s) FILTER (kind < 4) AS base
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms
FROM docs LEFT JOIN texts USING (rid)
"""


OP11_SQL = _sql()
