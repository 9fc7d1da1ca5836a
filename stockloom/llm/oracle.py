"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .chat import ASSISTANT, END, NEXT, START
from .mixing import RANGE_ROWS
from .quality_rules import BOILERPLATE, LINE_END, SEPARATORS, SYMBOLS, LineRules

_WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{_WORD}')"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _without(text: str, pattern: str) -> str:
    return f"length(regexp_replace({text}, '{_quoted(pattern)}', '', 'g'))"


def mixing_ctes(docs: str) -> str:
    """CTEs up to ``placed``: every document with size, target, whole epochs, rest and the words before it."""
    return f"""
    sized AS (SELECT *, len({_words("coalesce(text, '')")})::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '') || ':' || len({_words("coalesce(text, '')")})::VARCHAR || ':' || md5(coalesce(text, ''))) AS k
        FROM {docs}),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM totals),
    levels AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lv,
        row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST) AS place FROM weighed
        WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lv, place) FROM levels WHERE cap / w >= lv) * w, cap)) AS target
        FROM levels),
    placed AS (SELECT s.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
        floor(t.target)::BIGINT - CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END * t.source_size AS rest,
        (sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before_words
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)"""


def _mixing() -> str:
    return f"""WITH {mixing_ctes("documents")}
    SELECT doc_id, size, source_size, target,
        (epochs * size + greatest(0, least(size, rest - before_words)))::BIGINT AS taken FROM placed"""


def _chat() -> str:
    esc = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    return f"""WITH turns AS (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    placed AS (SELECT conv_id, {role} AS role, {text} AS text,
        row_number() OVER w AS place, lag({role}) OVER w AS previous FROM turns
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {role}, {text}))
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
        sum(length({esc.format("text")}) + CASE WHEN previous IS NOT NULL AND previous = role THEN {len(NEXT)}
            ELSE {len(START) + 1 + len(END)} + length(replace({esc.format("role")}, chr(10), '<\\n')) END)::BIGINT AS formatted_chars
    FROM placed GROUP BY conv_id"""


def _line_fails(line: str, rules: LineRules) -> str:
    chars = _without(line, _GAP)
    symbols = f"(length({line}) - {_without(line, f'[{SYMBOLS}]+')})"
    seps = f"(length({line}) - {_without(line, f'[{SEPARATORS}]+')})"
    n = f"len({_words(line)})"
    upper = f"(length({line}) - {_without(line, chr(92) + 'p{Lu}+')})"
    lower = f"(length({line}) - {_without(line, chr(92) + 'p{Ll}+')})"
    return f"""(({seps} > 0 AND {seps} * {rules.separators_per} >= {n}) OR {symbols} * 100 > {chars} * {rules.max_symbols}
        OR ({n} >= {rules.shout_words} AND {upper} > {lower} * 2)
        OR ({n} <= {rules.boiler_words} AND regexp_matches({line}, '{_quoted(BOILERPLATE)}'))
        OR ({n} < {rules.short_line} AND NOT regexp_matches({line}, '{_quoted(LINE_END)}')))"""


def quality_ctes(docs: str, rules: LineRules = LineRules()) -> str:
    """CTEs up to ``judged``: every document with its figures, the cleaned text and both verdicts."""
    k = rules.window
    return f"""
    numbered AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
    parts AS (SELECT rid, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
        array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)),
            lambda x: NOT regexp_matches(x, '{_WORD}') OR NOT {_line_fails('x', rules)}), chr(10)) AS cleaned FROM numbered),
    windows AS (SELECT rid, i, array_to_string(w[i:i + {k - 1}], ' ') AS win
        FROM (SELECT rid, w, unnest(range(1, len(w) - {k - 2})) AS i FROM parts WHERE len(w) > {k})),
    twins AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
    covered AS (SELECT rid, sum(least({k}, coalesce(nxt - i, {k})))::BIGINT AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twins) GROUP BY rid),
    figures AS (SELECT p.rid, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - {_without('t', f'[{SYMBOLS}]+')})::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        {_without('cleaned', _GAP)}::BIGINT AS kept_chars, cleaned FROM parts p LEFT JOIN covered c ON p.rid = c.rid),
    judged AS (SELECT n.*, f.* EXCLUDE (rid),
        (n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat}) AS base_failed,
        (word_chars - kept_chars) * 100 > word_chars * {rules.max_loss} AS lost
        FROM numbered n JOIN figures f ON n.rid = f.rid)"""


def _quality() -> str:
    return f"""WITH {quality_ctes("documents")}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT lost AS kept, kept_chars FROM judged"""


def _phrases() -> str:
    """Counts by position, scores in 128-bit integers."""
    return r"""WITH parts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM parts),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
    placed AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM starts),
    totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
    f1 AS (SELECT lang, a AS p, count(*) AS f FROM placed GROUP BY ALL),
    f2 AS (SELECT lang, a || ' ' || b AS p, any_value(a) AS a, any_value(b) AS b, count(*) AS f FROM placed WHERE b IS NOT NULL GROUP BY lang, a || ' ' || b),
    f3 AS (SELECT lang, a || ' ' || b || ' ' || c AS p, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, count(*) AS f
        FROM placed WHERE c IS NOT NULL GROUP BY lang, a || ' ' || b || ' ' || c),
    inside AS (SELECT lang, p, max(f) AS f FROM (
        SELECT lang, a || ' ' || b AS p, f FROM f3 WHERE f >= 10 UNION ALL SELECT lang, b || ' ' || c, f FROM f3 WHERE f >= 10) GROUP BY ALL),
    cuts AS (
        SELECT f2.lang, f2.p, f2.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2
            JOIN f1 l ON l.lang = f2.lang AND l.p = f2.a JOIN f1 r ON r.lang = f2.lang AND r.p = f2.b
            LEFT JOIN inside x ON x.lang = f2.lang AND x.p = f2.p
            WHERE f2.f >= 10 AND NOT coalesce(100 * x.f >= 50 * f2.f, false)
        UNION ALL SELECT f3.lang, f3.p, f3.f, 1, l.f, r.f FROM f3
            JOIN f1 l ON l.lang = f3.lang AND l.p = f3.a JOIN f2 r ON r.lang = f3.lang AND r.p = f3.b || ' ' || f3.c WHERE f3.f >= 10
        UNION ALL SELECT f3.lang, f3.p, f3.f, 2, l.f, r.f FROM f3
            JOIN f2 l ON l.lang = f3.lang AND l.p = f3.a || ' ' || f3.b JOIN f1 r ON r.lang = f3.lang AND r.p = f3.c WHERE f3.f >= 10),
    scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
    lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM lowest WHERE place = 1)
    SELECT r.lang, r.rank, r.p AS phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000"""


def _hard_negatives() -> str:
    """Every anchor against every row; products of small whole numbers are exact in doubles."""
    return """WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            [floor(256 * v::DOUBLE) FOR v IN embedding] AS x FROM embeddings
            WHERE label IS NOT NULL AND len([v FOR v IN embedding IF v IS NOT NULL AND isfinite(v)]) = len(embedding)),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
        FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
        FROM scored WHERE same) WHERE place <= 5),
    negatives AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
        AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5"""


def oracle_queries() -> dict[str, str]:
    return {
        "op1_source_mixing": _mixing(), "op5_chat_formatting": _chat(), "op8_quality_rules": _quality(),
        "op11_phrase_collocations": _phrases(), "op13_hard_negatives": _hard_negatives(),
    }
