"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, conversations, decontam, langid, licenses, linededup, minhash, pii, quality, suffix, warc
from ._common import shared_dir, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write one record per page, read all back by ranges, and hold each payload against its header's digest."""
    folder = shared_dir(spark)
    written = warc.write(warc.plan(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    back = warc.read(written, folder).select(
        F.col("record_id").alias("page_id"), "url", "record_type", "refers_to", F.col("header_digest").alias("payload_digest"),
        F.when(F.col("record_type") == "response", F.octet_length("payload")).cast("long").alias("n"),
        (F.sha2("payload", 256) == F.col("header_digest")).alias("same"))
    back.write.parquet(f"{folder}/read")  # narrow rows; else the archives would be read for either side of the join
    back = spark.read.parquet(f"{folder}/read")
    first = back.filter("record_type = 'response' and refers_to is null").groupBy(F.col("page_id").alias("first"), F.col("payload_digest").alias("d")).agg(F.max("n").alias("first_n"))
    out = back.join(first, (F.col("refers_to") == F.col("first")) & (F.col("payload_digest") == F.col("d")), "left")
    checked = F.when((F.col("record_type") == "revisit") | F.col("same"), F.coalesce("n", "first_n")).otherwise(F.raise_error(F.lit("a payload does not have its header's digest")).cast("long"))
    return out.select("page_id", checked.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the language and the id's binary digits are the path. They have no file names, so one that declares a licence speaks for its directory."""
    path = F.concat_ws("/", F.coalesce("lang", F.lit("")), F.array_join(F.split(F.bin("doc_id"), ""), "/"))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    folder = shared_dir(spark)
    licenses.detect(files).drop("text").write.parquet(f"{folder}/detected")  # else the texts would be read for each use
    out = licenses.inherit(spark.read.parquet(f"{folder}/detected"), "doc_id", "path", F.lit(True))
    return out.select("doc_id", "license", F.round("score", 9).alias("score"), "line", "kind", "basis", "origin")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def vocabulary_path() -> str:
    """The 50k byte-level vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage the conversations, repair them, and describe each: only the hash of a repaired conversation gathers its texts."""
    rows, folder = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), shared_dir(spark)
    flagged = conversations.faults(conversations.damage(rows))
    conversations.solve(flagged).write.parquet(f"{folder}/solved")
    solved = spark.read.parquet(f"{folder}/solved")
    line = F.struct("id", "part", F.concat_ws(":", "role", "text").alias("line"))
    texts = conversations.repaired(flagged, solved).groupBy("k").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    digest = texts.select("k", F.sha2(F.array_join("lines.line", "\n").cast("binary"), 256).alias("repaired_sha256"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    out = rows.select("conv_id").distinct().withColumn("k", key).join(solved.drop("conv_id", "blocks"), "k", "left").join(conversations.gaps(flagged), "k", "left").join(digest, "k", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_minhash": op2_minhash,
    "op3_licenses": op3_licenses,
    "op4_suffix": op4_suffix,
    "op5_pii": op5_pii,
    "op6_ann": op6_ann,
    "op7_bpe": op7_bpe,
    "op8_linededup": op8_linededup,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_langid": op12_langid,
    "op13_conversations": op13_conversations,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _edit(cell: str, cost: str, letter: str) -> str:
    """A cell (nine digits of cost, then the audit) after an edit, in SQL."""
    return f"lpad((left({cell}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({cell}, 10) || {letter}"


def _inserted(s0: str, s1: str, s2: str, s3: str) -> tuple[str, str]:
    """States after u and after a, with the inserts that may be worth it, in SQL."""
    one = lambda *cells: [_edit(c, "2", "'I'") for c in cells]
    two = lambda *cells: [_edit(c, "4", "'II'") for c in cells]
    return f"least({', '.join([s2, *one(s0, s1, s3)])})", f"least({', '.join([s3, *one(s2), *two(s0, s1)])})"


_U, _A = _inserted("s0", "s1", "s2", "s3")
_STRIPPED = "rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ')"

#: DuckDB SQL where SQL can express the operator. The others are tested against brute force, a library or held-out labels.
ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages), f AS (SELECT h, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to, url FROM p LEFT JOIN f USING (h)""",
    "op8_linededup": r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), line AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM s),
w AS (SELECT *, list_filter(string_split(regexp_replace(line, '[\t\r]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM line),
each AS (SELECT w, min((doc_id, no)) AS first FROM w WHERE len(w) > 0 GROUP BY 1), big AS (SELECT * FROM each WHERE len(w) >= 10),
small AS (SELECT w, first, array_to_string(w, ' ') AS s FROM each WHERE len(w) < 10 AND length(array_to_string(w, ' ')) >= 10),
keys AS (SELECT w, first, i || '|' || array_to_string(w[1:i], ' ') || '|' || array_to_string(w[i + 2:], ' ') AS k FROM big, unnest(range(len(w))) r(i)
  UNION ALL SELECT w, first, i || '|' || array_to_string(w[1:i], ' ') || '|' || array_to_string(w[i + 1:], ' ') FROM big, unnest(range(len(w) + 1)) r(i)
  UNION ALL SELECT w, first, 'letters|' || i || '|' || left(s, i) || '|' || substr(s, i + 2) FROM small, unnest(range(length(s))) r(i)
  UNION ALL SELECT w, first, 'letters|' || i || '|' || left(s, i) || '|' || substr(s, i + 1) FROM small, unnest(range(length(s) + 1)) r(i)),
head AS (SELECT k, min(first) AS head FROM keys GROUP BY 1 HAVING count(*) > 1), near AS (SELECT DISTINCT w FROM keys JOIN head USING (k) WHERE head < first),
flag AS (SELECT w.*, len(w) > 0 AND ((doc_id, no) <> first OR near.w IS NOT NULL) AS gone FROM w LEFT JOIN each USING (w) LEFT JOIN near USING (w))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256 FROM flag GROUP BY 1""",
    "op10_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), g AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS gram FROM b, unnest(range(len(w) - least(len(w), 13) + 1)) r(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), k AS (SELECT DISTINCT k FROM g), x AS (SELECT doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') AS gram FROM d CROSS JOIN k, unnest(range(len(w) - k + 1)) r(i)),
h AS (SELECT doc_id, i, x.k, item_id FROM x JOIN g USING (gram)), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + k)) r(p) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t), n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, array_to_string(w[i + 1:i + k], ' ') AS p, count(*) AS f FROM w, unnest([1, 2, 3, 4, 5]) u(k), unnest(range(len(w) - k + 1)) r(i) GROUP BY ALL HAVING count(*) >= 100),
held AS (SELECT DISTINCT lang, f, unnest([array_to_string(string_split(p, ' ')[1:k - 1], ' '), array_to_string(string_split(p, ' ')[2:k], ' ')]) AS p FROM f WHERE k > 2),
c AS (SELECT f.lang, f.p, f.k, f.f AS a FROM f ANTI JOIN held USING (lang, p, f) WHERE f.k > 1),
cut AS (SELECT lang, p, a, i, array_to_string(string_split(p, ' ')[1:i], ' ') AS x, array_to_string(string_split(p, ' ')[i + 1:k], ' ') AS y FROM c, unnest(range(1, k)) r(i)),
s AS (SELECT cut.lang, cut.p, a, i, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n::HUGEINT) // (x.f::HUGEINT * y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.p = cut.x JOIN f y ON y.lang = cut.lang AND y.p = cut.y JOIN n ON n.lang = cut.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, i) AS o FROM s),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM b WHERE o = 1)
SELECT * FROM o WHERE rank <= 2000""",
    "op13_conversations": f"""
WITH RECURSIVE t AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
o AS (SELECT coalesce('=' || conv_id, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k, turn, role, text, xor(list_reduce(list_transform(string_split(key, ''), lambda x: unicode(x)::BIGINT), lambda c, b: xor(c >> 8, t.t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 20 AS h FROM o, t),
d AS (SELECT k, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) r(i)),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, {_STRIPPED} AS s FROM d),
q AS (SELECT *, s = '' AS blank, s <> '' AND row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS duplicate, left(role, 1) AS f, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS g FROM p),
r AS (SELECT *, NOT blank AND NOT duplicate AND right(s, 1) NOT IN ('.', '!', '?') AS truncated, NOT blank AND NOT duplicate AS stays FROM q),
n AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated, sum((g IS NOT NULL AND g || f NOT IN ('su', 'ua', 'au'))::INT) AS illegal, count(*) AS n FROM r GROUP BY 1),
e AS (SELECT k, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM n
  UNION ALL SELECT k, i, {_edit('s0', '3', "'D'")}, least({_edit('s1', '3', "'D'")}, CASE WHEN stays AND f = 's' THEN {_edit('s0', 'c', "'K'")} END),
    least({_edit('u', '3', "'D'")}, CASE WHEN stays AND f = 'u' THEN {_edit('least(s0, s1, a)', 'c', "'K'")} WHEN stays THEN {_edit('least(s0, s1, a)', '(c + 2)', "'R'")} END),
    least({_edit('a', '3', "'D'")}, CASE WHEN stays AND f = 'a' THEN {_edit('u', 'c', "'K'")} WHEN stays THEN {_edit('u', '(c + 2)', "'R'")} END)
  FROM (SELECT r.k, r.i, s0, s1, {_U} AS u, {_A} AS a, stays, f, truncated::INT AS c FROM e JOIN r ON r.k = e.k AND r.i = e.i + 1)),
b AS (SELECT n.*, least(s0, {_A}) AS best FROM e JOIN n ON n.k = e.k AND n.n = e.i),
l AS (SELECT k, x, x.j AS j FROM b, unnest(list_transform(string_split(substr(best, 10), ''), lambda c, j: {{'c': c, 'j': j}})) u(x) WHERE length(best) > 9),
m AS (SELECT k, j, x.c AS c, count(*) FILTER (x.c <> 'I') OVER (PARTITION BY k ORDER BY j) AS i, count(*) FILTER (x.c <> 'D') OVER (PARTITION BY k ORDER BY j) AS z, count(*) FILTER (x.c <> 'D') OVER (PARTITION BY k) AS total FROM l),
w AS (SELECT m.k, sha256(string_agg(CASE WHEN c = 'K' THEN role WHEN (z - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM m LEFT JOIN r ON r.k = m.k AND r.i = m.i WHERE c <> 'D' GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.k = coalesce('=' || conv_id, '') LEFT JOIN w ON w.k = b.k""",
}
