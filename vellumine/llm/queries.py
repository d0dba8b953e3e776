"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, exact_dedup, fill_middle, fingerprints, html_extract, langid, mixing, near_dedup, pii, toxicity, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and fitted rate of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels"), passed=["doc_id"])


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited copy and their likenesses."""
    return fingerprints.drift(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False)) & F.col("lang").isNotNull()))
    found = langid.predict(docs.drop("lang").withColumn("held_out", F.coalesce(held_out, F.lit(False))), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, normalised and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a linked, ordered and serialised call, result or message."""
    return chat.link(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "kind", "call_id", "status", "after", "depth", "canonical")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of two tokenizers' tokens in every document."""
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.held_out()
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.predict(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in prefix, middle and suffix at lines, put in a new order and restored from it."""
    found = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256")
    )


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_fingerprints": op3_fingerprints,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_html_extraction": op9_html_extraction,
    "op10_chat_tool_calls": op10_chat_tool_calls,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_fill_middle": op13_fill_middle,
}

# The patterns of the kinds without possessive repetition and look-behind, which DuckDB lacks.
SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": pii.IBAN,
    "short_card": r"[0-9](?:[\x20-]?[0-9])+",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
SQL_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
SQL_LUHN = f"""list_sum(list_transform(range(length({SQL_DIGITS})), lambda i: CASE WHEN i % 2 = 0
    THEN substr({SQL_DIGITS}, (length({SQL_DIGITS}) - i)::INT, 1)::INT
    ELSE substr({SQL_DIGITS}, (length({SQL_DIGITS}) - i)::INT, 1)::INT * 2
         - CASE WHEN substr({SQL_DIGITS}, (length({SQL_DIGITS}) - i)::INT, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
SQL_ALONE = "NOT regexp_matches(CASE WHEN x.s > 0 THEN substr(t, x.s::INT, 1) ELSE '' END || ' ' || substr(t, x.e::INT + 1, 1), '[A-Za-z0-9]')"
SQL_IBAN = "(substr(replace(x.m, ' ', ''), 5) || substr(replace(x.m, ' ', ''), 1, 4))"
SQL_VALUE = f"(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({SQL_IBAN}, i::INT, 1)) - 1)"
SQL_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(x.m, '.'), lambda y: length(ltrim(y, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(y, '0'), '') AS INT), 0) <= 255))",
    "card": f"length({SQL_DIGITS}) BETWEEN 16 AND 19 AND {SQL_LUHN}",
    "phone": f"length({SQL_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"""{SQL_ALONE} AND list_reduce(list_prepend(0::BIGINT,
        list_transform(range(1, length({SQL_IBAN}) + 1), lambda i: {SQL_VALUE}::BIGINT)), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1""",
    "short_card": f"{SQL_ALONE} AND length({SQL_DIGITS}) BETWEEN 13 AND 15 AND {SQL_LUHN}",
    "ssn": f"""{SQL_ALONE} AND NOT contains(CASE WHEN x.s > 0 THEN substr(t, x.s::INT, 1) ELSE '' END || substr(t, x.e::INT + 1, 1), '-')
        AND NOT regexp_matches(x.m, '^(?:000|666|9)|-00-|-0000$')""",
}


def _pii_sql() -> str:
    found, listed, counts = [], [], []
    for k in pii.KINDS:
        r, words = SQL_PATTERNS[k.name], pii.CONTEXT_WORDS[k.name]
        near = f"lower(substr(t, greatest(x.s - {pii.CONTEXT}, 0)::INT + 1, (x.s - greatest(x.s - {pii.CONTEXT}, 0))::INT) || ' ' || substr(t, x.e::INT + 1, {pii.CONTEXT}))"
        score = f"({k.score}::DOUBLE + CASE WHEN regexp_matches({near}, '(?:^|[^a-z])(?:{words})(?:$|[^a-z])') THEN {pii.BONUS}::DOUBLE ELSE 0::DOUBLE END)"
        spans = f"""list_transform(list_zip(regexp_extract_all(t, '{r}'), string_split_regex(t, '{r}')[1:len(regexp_extract_all(t, '{r}'))], range(len(regexp_extract_all(t, '{r}')))),
            lambda z: {{'m': z[1], 's': list_sum(list_transform(string_split_regex(t, '{r}')[1:z[3] + 1], lambda q: length(q)))
                + coalesce(list_sum(list_transform(regexp_extract_all(t, '{r}')[1:z[3]], lambda q: length(q))), 0)}})"""
        valid = SQL_VALID[k.name] + ("" if k.base else f" AND {score} >= {pii.MIN_SCORE}::DOUBLE")
        placed = f"list_transform({spans}, lambda z: {{'m': z.m, 's': z.s, 'e': z.s + length(z.m)}})"
        found.append(f"list_transform(list_filter({placed}, lambda x: {valid}), lambda x: {{'at': '{k.name}:' || x.s::BIGINT || ':' || x.e::BIGINT, 'score': {score}}}) AS {k.name}")
        listed.append(k.name)
        if k.base:
            counts.append(f"len({k.name})::BIGINT AS n_{k.name}")
    base, every = ("list_concat(" + ", ".join(x) + ")" for x in (listed[:4], listed))
    text = "array_to_string(list_transform({}, lambda v: v.at), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {", ".join(found)} FROM d)
        SELECT doc_id, {", ".join(counts)}, sha256({text.format(base)}) AS base_sha256, {text.format(every)} AS spans,
               (len({every}) - len({base}))::BIGINT AS n_added, list_max(list_transform({every}, lambda v: v.score)) AS max_score FROM f"""


ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages)
        SELECT page_id,
               strlen(html)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                   ((strpos('0123456789abcdef', substr(sha1(html), ((5 * i) // 4 + 1)::INT, 1)) - 1) * 16
                    + strpos('0123456789abcdef', substr(sha1(html), ((5 * i) // 4 + 2)::INT, 1)) - 1)
                   // (1 << (3 - (5 * i) % 4)::INT) % 32)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p""",
    "op10_chat_tool_calls": """
        WITH e AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text,
                   CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
                   CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS of_turn
            FROM conversations),
        j AS (
            SELECT *, CASE kind
                WHEN 'call' THEN '{"arguments":{"text":' || to_json(text)::VARCHAR || '},"id":"turn-' || of_turn || '","name":"reply","type":"tool_call"}'
                WHEN 'result' THEN '{"content":' || to_json(text)::VARCHAR || ',"id":"turn-' || of_turn || '","type":"tool_result"}'
                ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"type":"message"}' END AS canonical
            FROM e),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, kind, of_turn ORDER BY turn, canonical) AS place,
                   count_if(kind = 'call') OVER (PARTITION BY conv_id, of_turn) > 0 AS called,
                   count_if(kind = 'result') OVER (PARTITION BY conv_id, of_turn) > 0 AS answered
            FROM j)
        SELECT conv_id, turn, kind, 'turn-' || of_turn AS call_id,
               CASE WHEN kind = 'message' THEN 'message'
                    WHEN place > 1 THEN 'duplicate_' || kind
                    WHEN kind = 'call' AND text = '' THEN 'invalid'
                    WHEN kind = 'call' AND NOT answered THEN 'unanswered'
                    WHEN kind = 'result' AND NOT called THEN 'orphan'
                    ELSE 'ok' END AS status,
               turn AS after,
               CASE WHEN kind = 'result' AND called THEN 1 ELSE 0 END AS depth,
               canonical
        FROM n""",
    "op4_pii": _pii_sql(),
    "op13_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l,
                     list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d),
        c AS (SELECT doc_id, t, l, h, len(l) AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b FROM l),
        p AS (SELECT doc_id, t, n,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                     array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:n], '') AS suffix FROM c)
        SELECT doc_id, n::BIGINT AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}
