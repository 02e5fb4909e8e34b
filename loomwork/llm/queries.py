"""The numbered queries and, where SQL can say it, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm import alignment, chat, decontaminate, language, lmscore, minhash, pieces, pii, quality, repeats, simhash, urls, variants
from loomwork.llm.common import table


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The conversation -7 that holds the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op3_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(extra)
    records = rows.select("conv_id", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return chat.digest_turns(chat.canonical_turns(records))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_lmscore(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lmscore.differences(docs, table(spark, sf_dir, "labels"))


def op8_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_pieces(spark, sf_dir):
    return pieces.encode_decode(table(spark, sf_dir, "documents"))


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op11_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_minhash(spark, sf_dir):
    return minhash.edited_pairs(table(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality": op1_quality, "op2_simhash": op2_simhash, "op3_chat": op3_chat, "op4_decontaminate": op4_decontaminate, "op5_urls": op5_urls, "op6_pii": op6_pii, "op7_lmscore": op7_lmscore, "op8_repeats": op8_repeats, "op9_pieces": op9_pieces, "op10_language": op10_language, "op11_variants": op11_variants, "op12_minhash": op12_minhash, "op13_alignment": op13_alignment}
#: The template's arithmetic, as the operator's module states it: head, escaped text, end mark and line feed.
OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + length('### : </turn>') + 1
             + CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE length(role) + 3 END AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

#: Plain patterns, their places from the text between the matches, and the checks. Secrets are whole runs of letters
#: and digits; account numbers are letters as 10 to 35, turned round, with a remainder of 1 by 97.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
p(kind, ord, pattern) AS (VALUES ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  ('card', 2, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]'), ('iban', 4, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b'), ('secret', 5, '[A-Za-z0-9]+')),
k AS (SELECT r, doc_id, t, kind, ord, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS g FROM d, p),
e AS (SELECT r, doc_id, t, kind, ord, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM k WHERE len(m) > 0),
w AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS digits, regexp_replace(m, '\x20', '', 'g') AS plain FROM e),
l AS (SELECT *, stop - length(m) AS start, coalesce(lag(stop) OVER (PARTITION BY r, kind ORDER BY stop), 0) AS prev, coalesce(lead(stop - length(m)) OVER (PARTITION BY r, kind ORDER BY stop), length(t)) AS next
  FROM w WHERE kind <> 'secret' OR regexp_full_match(m, '[0-9a-f]{32,64}')),
f AS (SELECT * FROM l WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda q: length(ltrim(q, '0')) > 3 OR coalesce(try_cast(ltrim(q, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN digits[length(digits) - j]::INTEGER ELSE digits[length(digits) - j]::INTEGER * 2 - CASE WHEN digits[length(digits) - j]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(string_split(plain[5:] || plain[:4], ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE c::INTEGER END)), lambda a, x: (CASE WHEN x > 9 THEN a * 100 + x ELSE a * 10 + x END) % 97) = 1
    ELSE regexp_matches(substring(t, greatest(prev, start - 40) + 1, start - greatest(prev, start - 40)), '(?i)\b(?:token|secret|key|password|passwd|api)\b')
      OR regexp_matches(substring(t, stop + 1, least(next, stop + 40) - stop), '(?i)\b(?:token|secret|key|password|passwd|api)\b') END),
a AS (SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < 4), '') AS base,
  count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone FROM f GROUP BY r)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""
ORACLE_SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op6_pii": OP6_SQL}
