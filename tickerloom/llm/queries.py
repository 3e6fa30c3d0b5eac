"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tickerloom.llm import (
    ann, collocations, decontamination, language, mixing, ngram_join, periodic, pii, sharding, simhash, token_counts, url_filter, warc,
)
from tickerloom.llm.registry import query
from tickerloom.llm.work import table

SHARDS = 24


@query("op6_shard")
def op6(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    plain = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    placed = sharding.shard_by_bytes(docs.withColumn("text_crc32", F.crc32(plain)), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# The rules, as verdict, host, path.
RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
#: Hosts with one of these words as a part of a label are listed.
LISTED_WORDS = r"(^|[.-])(adult|casino|spam|malware|phish)([.-]|$)"


@query(
    "op8_url_filter",
    sql=f"""
WITH cut AS (
    SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), low AS (
    SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), judged AS (
    SELECT *, CASE
        WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM low
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '{LISTED_WORDS}') THEN 'block' ELSE 'allow' END AS verdict
FROM judged""",
)
def op8(spark, folder):
    urls = table(spark, folder, "pages").select("page_id", "url")
    pages = urls.withColumns({"host": url_filter.host_of("url"), "path": url_filter.path_of("url")})
    hosts = pages.groupBy(F.col("host").alias("key")).agg(F.first(F.col("host").rlike(LISTED_WORDS)).alias("listed"))
    judged = url_filter.with_listed(pages, "host", hosts).withColumns(url_filter.rule_columns(RULES))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"))


@query("op1_token_counts")
def op1(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = token_counts.read_vocabulary(token_counts.default_vocabulary(spark))
    return token_counts.section_tokens(docs, ranks)


#: Words of a lower-cased text, as DuckDB's pattern class.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op10_decontaminate",
    sql=f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT item_id, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS pos, w FROM i WHERE len(w) > 0
),
wins AS (SELECT item_id, n, list_slice(w, pos, pos + n - 1) AS words FROM win),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
    SELECT row, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM d, sizes WHERE len(w) >= n
),
hits AS (
    SELECT p.row, p.pos, p.n, wins.item_id FROM places p JOIN wins
        ON wins.n = p.n AND wins.words[1] = p.w[p.pos] AND wins.words = list_slice(p.w, p.pos, p.pos + p.n - 1)
),
n_hits AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(pos, pos + n)) AS pos FROM hits) GROUP BY row),
n_items AS (
    SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hits USING (row) LEFT JOIN n_items USING (row)""",
)
def op10(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    hits = decontamination.counted(decontamination.benchmark_hits(docs, items))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op7_personal_data")
def op7(spark, folder):
    found = pii.personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op4_language")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    named = language.with_language(docs.select("doc_id", "text"), language.fit(docs))
    return named.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op3_nearest")
def op3(spark, folder):
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_mix_sources")
def op9(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    placed = mixing.schedule(docs, until_first=False)
    return placed.select("doc_id", "source", "size", "block", "release", "deadline", "slot", "in_mix")


@query(
    "op5_warc",
    sql="""
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM g""",
)
def op5(spark, folder):
    back, _ = warc.archived(table(spark, folder, "pages"))
    return back.select(F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("bigint").alias("refers_to"))


@query(
    "op11_collocations",
    sql=r"""
WITH t AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size
),
f AS (
    SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS n
    FROM places GROUP BY ALL
),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, n AS a FROM f WHERE size > 1 AND n >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
scored AS (
    SELECT cuts.lang, cuts.phrase, k, a, l.n AS l, r.n AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.n + r.n) AS BIGINT) AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.size = k AND l.phrase = array_to_string(list_slice(words, 1, k), ' ')
    JOIN f r ON r.lang = cuts.lang AND r.size = cuts.size - k
        AND r.phrase = array_to_string(list_slice(words, k + 1, cuts.size), ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, a, words, size, inner_size, unnest(range(1, size - inner_size + 2)) AS i
    FROM c, (SELECT unnest([2, 3]) AS inner_size) WHERE inner_size < size
),
longest AS (
    SELECT lang, array_to_string(list_slice(words, i, i + inner_size - 1), ' ') AS phrase, max(a) AS most FROM inside GROUP BY ALL
),
kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN longest USING (lang, phrase)
    WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
)
def op11(spark, folder):
    return collocations.collocations(table(spark, folder, "documents").select("text", "lang"))


def _repeating(n, h):
    """Places of the words of every tenth text: from some word on, the words of a first period over and over."""
    if h % 10 or not n:
        return None
    g = int(h) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


@query("op12_periodic_runs")
def op12(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(docs, order=_repeating, order_by=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    named = found.withColumns({"best": best, "lines": F.concat_ws("", lines)})
    return named.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_simhash")
def op13(spark, folder):
    return simhash.near_copies(table(spark, folder, "documents").select("doc_id", "text"), words=4, distance=4, seed=42)


@query("op2_ngram_join")
def op2(spark, folder):
    found = ngram_join.joined(table(spark, folder, "documents").select("doc_id", "text"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")
