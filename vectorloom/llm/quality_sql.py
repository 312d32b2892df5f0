"""DuckDB SQL of the quality query, written independently of the operator's expressions."""

from __future__ import annotations

from vectorloom.llm.quality import QualityRules


def sql(rules: QualityRules = QualityRules()) -> str:
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    count = lambda keep: f"length(regexp_replace(s, '[^{keep}]+', '', 'g'))"
    term = "(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2"
    return rf"""
        WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
        twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams),
        rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(3) s(k) WHERE n > 1 GROUP BY doc_id),
        b AS (
            SELECT w.doc_id, lang, t, len(w) AS n_words, array_to_string(w, '') AS s, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   list_filter(string_split(t, chr(10)), lambda x: length(trim(x, {blanks})) > 0) AS lines, coalesce(rep.n, 0) AS n_repeat_words,
                   list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D.,;:!?]+'), lambda x: x <> '') AS terms
            FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
        k AS (
            SELECT *, length(s) AS word_chars, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
                   [{count(chr(92) + 'p{Ll}')}, {count(chr(92) + 'p{Lu}')}, {count(chr(92) + 'p{Lt}' + chr(92) + 'p{Lm}' + chr(92) + 'p{Lo}' + chr(92) + 'p{M}')}, {count(chr(92) + 'p{N}')}, {count(".,;:?!''" + '"' + "()" + chr(92) + "-")}] AS k
            FROM b),
        f AS (SELECT *, k || [word_chars - list_sum(k)::BIGINT] AS c FROM k),
        good AS (SELECT * FROM f WHERE NOT base_failed),
        tc AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(terms) AS term FROM good WHERE lang IS NOT NULL) GROUP BY ALL),
        tl AS (SELECT lang, sum(n) AS n FROM tc GROUP BY lang HAVING sum(n) >= {rules.min_reference_terms}),
        ref AS (
            SELECT tc.lang, term, tc.n / tl.n AS q FROM tc JOIN tl ON tl.lang = tc.lang
            QUALIFY row_number() OVER (PARTITION BY tc.lang ORDER BY tc.n DESC, term) <= {rules.common_words}),
        reft AS (SELECT lang, sum(q) AS total FROM ref GROUP BY lang),
        own AS (
            SELECT doc_id, CASE WHEN lang IS NULL THEN seen IS NOT NULL AND 2 * length(translate(letters, coalesce(seen, ''), '')) <= length(letters) ELSE lang IN (SELECT lang FROM tl) END AS own
            FROM (SELECT doc_id, lang, regexp_replace(lower(t), '[^\p{{L}}]+', '', 'g') AS letters FROM f), (SELECT string_agg(term, '') AS seen FROM ref)),
        dc AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(terms) AS term FROM good) GROUP BY ALL),
        met AS (
            SELECT doc_id, lang, sum({term} - q / 2) AS d, sum(p) AS p
            FROM (SELECT dc.doc_id, ref.lang, q, dc.n / len(good.terms) AS p FROM dc JOIN ref ON ref.term = dc.term JOIN good ON good.doc_id = dc.doc_id) GROUP BY ALL),
        wd AS (
            SELECT doc_id, min(sqrt(least(1, greatest(0, d + total / 2 + {term})))) AS word_distance
            FROM (SELECT g.doc_id, coalesce(m.d, 0) AS d, total, greatest(0, 1 - coalesce(m.p, 0)) AS p, greatest(0, 1 - total) AS q
                  FROM good g CROSS JOIN reft LEFT JOIN met m ON m.doc_id = g.doc_id AND m.lang = reft.lang WHERE len(g.terms) >= {rules.min_terms})
            GROUP BY doc_id),
        cl AS (SELECT lang, [{', '.join(f'sum(c[{i}] / word_chars)' for i in range(1, 7))}] AS c FROM good GROUP BY lang),
        cr AS (
            SELECT lang, list_transform(c, lambda x: x / list_sum(c)) AS share, true AS own FROM cl WHERE lang IN (SELECT lang FROM tl)
            UNION ALL SELECT NULL, list_transform(c, lambda x: x / list_sum(c)), false FROM (SELECT [{', '.join(f'sum(c[{i}])' for i in range(1, 7))}] AS c FROM cl)),
        cd AS (
            SELECT doc_id, min(d) AS char_distance
            FROM (SELECT doc_id, lang, sqrt(least(1, greatest(0, sum({term})))) AS d
                  FROM (SELECT g.doc_id, cr.lang, unnest(list_transform(g.c, lambda x: x / list_sum(g.c))) AS p, unnest(cr.share) AS q
                        FROM good g JOIN own ON own.doc_id = g.doc_id JOIN cr ON cr.own = own.own WHERE g.word_chars >= {rules.min_chars}) GROUP BY doc_id, lang)
            GROUP BY doc_id)
        SELECT f.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed,
               round(char_distance, 9) AS char_distance, round(CASE WHEN own.own THEN word_distance END, 9) AS word_distance,
               NOT base_failed AND coalesce(char_distance, 0) <= {rules.max_char_distance} AND coalesce(CASE WHEN own.own THEN word_distance END, 0) <= {rules.max_word_distance} AS kept
        FROM f JOIN own ON own.doc_id = f.doc_id LEFT JOIN wd ON wd.doc_id = f.doc_id LEFT JOIN cd ON cd.doc_id = f.doc_id
    """
