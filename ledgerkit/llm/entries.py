"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit import session
from ledgerkit.llm import (
    decontaminate, jaccard, lexical, licenses, lines, lshforest, packing, prefixes, quality, repeats, secrets, shards,
    toxicity,
)
from ledgerkit.llm.common import id_remainder, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = session.settle(docs.select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), quality.features(F.col("text")).alias("stats")
    ))
    model = quality.train(stats.where("not held_out"), labels, "doc_id", "stats", "quality")
    return quality.predict(stats, model, "stats")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), with_text=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shuffle(table(spark, sf_dir, "documents"), 24, seed=6)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lines.judge(docs.select("doc_id", "text"), lines.train(docs, labels))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels")
    network = toxicity.train(docs.where("not held_out"), labels.where(id_remainder("doc_id", 5) != 0))
    return toxicity.predict(docs, network)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = secrets.train(secrets.weak_labels(session.settle(secrets.findings(docs))))
    return secrets.report(docs, forest)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = session.settle(lexical.build(table(spark, sf_dir, "documents")))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_repeat_removal": op4_repeat_removal,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_minhash_forest": op13_minhash_forest,
}

SQL: dict[str, str] = {
    "op2_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM sets
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
        comps AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN comps USING (doc_id)
    """,
    "op4_repeat_removal": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n FROM d),
        places AS (SELECT doc_id, h, unnest(range(0, n - 399)) AS p FROM b),
        strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS m FROM places),
        twice AS (SELECT m FROM strings GROUP BY m HAVING count(*) > 1),
        hits AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM strings SEMI JOIN twice USING (m)),
        runs AS (SELECT doc_id, p, count(*) FILTER (before IS NULL OR p > before + 400) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
        spans AS (SELECT doc_id, min(p) AS s, max(p) + 400 AS e FROM runs GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f FROM spans),
        cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last,
            string_agg(substr(h, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) AS head FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM b LEFT JOIN cut USING (doc_id)
    """,
    "op11_prefix_trie": """
        WITH crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        own AS (
            SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
            FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (
            SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(
                string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT c FROM own), crc),
        turns AS (
            SELECT ids.c, 0 AS part, p, r, x FROM ids JOIN own ON own.c = ids.base AND p <= h
            UNION ALL SELECT ids.c, 1, p, r, x FROM ids JOIN own ON own.c = ids.c AND p > h),
        placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM turns),
        seqs AS (
            SELECT ids.c, coalesce(list(concat(length(r), ':', r, length(x), ':', x) ORDER BY d) FILTER (d IS NOT NULL), []) AS s,
                coalesce(list(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) ORDER BY d) FILTER (d IS NOT NULL), []) AS w
            FROM ids LEFT JOIN placed ON ids.c = placed.c GROUP BY ids.c),
        depths AS (SELECT c, s, w, unnest(range(0, len(s) + 1)) AS d FROM seqs),
        steps AS (
            SELECT c, d, array_to_string(s[1:d], '') AS k, CASE WHEN d > 0 THEN array_to_string(s[1:d - 1], '') END AS pk,
                CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, len(s) AS n FROM depths),
        nodes AS (
            SELECT k, d, any_value(pk) AS pk, any_value(w) AS w, min(c) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
            FROM steps GROUP BY k, d),
        children AS (SELECT pk, count(*) AS n FROM nodes WHERE d > 0 GROUP BY pk),
        full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children ON nodes.k = children.pk),
        sums AS (
            SELECT a.k, sum(CASE WHEN y.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((y.n_convs - 1) * y.w) AS saved
            FROM full_nodes y JOIN steps a ON a.c = y.conv_id AND a.d <= y.d GROUP BY a.k)
        SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
            CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM full_nodes f JOIN sums USING (k) LEFT JOIN nodes p ON f.pk = p.k
    """,
    "op12_lexical_search": """
        WITH terms AS (
            SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        totals AS (
            SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM terms),
        occurs AS (
            SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM terms),
        tfs AS (SELECT d, doc_id, n, term, count(*) AS tf FROM occurs GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
            FROM tfs, totals GROUP BY term, n_docs),
        queries AS (
            SELECT item_id, term, count(*) AS c FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        scores AS (
            SELECT item_id, d, doc_id,
                CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM queries JOIN tfs USING (term) JOIN weights USING (term), totals GROUP BY item_id, d, doc_id),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 20
    """,
}

# The same rules with other shingles and another limit; whole components and rows kept.
SQL["op13_minhash_forest"] = SQL["op2_jaccard_join"].replace("len(w) < 5", "len(w) < 4").replace(
    "range(1, len(w) - 3)", "range(1, len(w) - 2)").replace("w[i:i + 4]", "w[i:i + 3]").replace(
    "75 * (a.n", "80 * (a.n").replace(
    "component_id FROM sets", "component_id, doc_id = component_id AS kept FROM sets")
