r"""SQL for DuckDB of the queries that SQL can express. Its regular expressions have no
lookaround, so some are worded differently from the Spark side."""

from textloom.functions import classify as K
from textloom.functions import tokenize as T
from textloom.plans.queries import LETTERS

_S = "[ \\t\\n\\r\\f\\x0B]"


def _q(s: str) -> str:
    return s.replace("'", "''")


_PARA = f"regexp_extract_all(text, '{_q(T.PARAGRAPH)}')"
_TOKEN = _q(T.TOKEN)
_NOT_PARTS = ", ".join(f"'{w}'" for w in T.NOT_PARTICLES)
_PARTICLE = _q(T.PARTICLE.replace("(?iu)", "(?i)"))


def _is_part(w: str) -> str:
    low = f"replace(lower({w}), '–', '-')"
    return f"(contains({low}, '-') AND {low} NOT IN ({_NOT_PARTS}) AND regexp_matches({w}, '{_PARTICLE}'))"


_SENTENCES = f"""
WITH p AS (SELECT doc_id, source, unnest({_PARA}) AS p, generate_subscripts({_PARA}, 1) - 1 AS para_id FROM documents),
m AS (SELECT *, regexp_replace(p, '([.!?…][»”\\")]*)({_S}+)([«„“\\"(—–-]*{_S}?[{T.UPPER}\\d])', '\\1{T.MARK}\\2\\3', 'g') AS m FROM p),
k AS (SELECT *, regexp_replace(m, '((?:^|[^\\p{{L}}])(?:{T.ABBREVIATIONS}|[{T.UPPER}])\\.){T.MARK}', '\\1', 'g') AS k FROM m),
a AS (SELECT doc_id, source, para_id, list_filter(list_transform(regexp_split_to_array(k, '{T.MARK}{_S}*'), lambda s: replace(regexp_replace(s, '{_S}+\\z', ''), chr(10), ' ')), lambda s: regexp_matches(s, '[^ \\t\\n\\r\\f\\x0B]')) AS s FROM k),
sents AS (SELECT doc_id, source, para_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_id FROM a)
"""
_KNOWN = "replace(replace(replace({0}, '’', ''''), 'ʼ', ''''), chr(769), '')"


def _known(c: str) -> str:
    return _KNOWN.format(c)


def _class(v: str) -> str:
    whole = lambda p: f"regexp_matches({v}, '^(?:{_q(p)})\\z')"
    return (
        f"CASE WHEN {whole(K.PUNCT)} THEN 'punct' WHEN {whole(K.SYMBOL)} THEN 'symb' WHEN {whole(K.XML_TAG)} THEN 'xmltag' "
        f"WHEN {whole(K.UKRAINIAN)} AND NOT regexp_matches({v}, '{_q(K.NOT_UKRAINIAN)}') THEN 'unknown' WHEN {whole(K.SINGLE)} THEN 'noninfl' WHEN {v} IS NOT NULL THEN 'unclass' END"
    )


_TAGGED = f"""
WITH tok AS (SELECT DISTINCT doc_id, para_id, sent_id, tok_id, tok_value AS value, clean, whitespace_before FROM tokens),
lex AS (SELECT DISTINCT {_known('form')} AS form, coalesce(lemma, form) AS lemma, tags FROM lexicon_uk WHERE form IS NOT NULL),
byform AS (
  SELECT form, list({{'lemma': lemma, 'tags': tags}} ORDER BY lemma, tags) AS readings FROM lex
  WHERE tags IS NOT NULL AND tags <> '' AND NOT ends_with(tags, '_END') AND NOT starts_with(tags, '<') GROUP BY form
),
t AS (SELECT *, {_known('coalesce(clean, value)')} AS f, {_class('value')} AS kind FROM tok),
tagged AS (
  SELECT t.doc_id, t.para_id, t.sent_id, t.tok_id, t.value, t.clean, t.whitespace_before,
    CASE WHEN t.value = '—' THEN [{{'lemma': coalesce(t.clean, t.value), 'tags': t.kind}}]
         ELSE coalesce(a.readings, b.readings, CASE WHEN kind IS NOT NULL THEN [{{'lemma': coalesce(t.clean, t.value), 'tags': t.kind}}] END) END AS readings
  FROM t LEFT JOIN byform a ON a.form = t.f LEFT JOIN byform b ON b.form = lower(t.f)
)
"""
_CYR = "regexp_matches({0}, '[а-яіїєґА-ЯІЇЄҐ]')"
_CAPITAL = "len(list_filter(readings, lambda r: regexp_matches(r.lemma, '^[А-ЯІЇЄҐA-Z]'))) > 0"
_STATS = f""",
by_word AS (SELECT lower({_known('coalesce(clean, value)')}) AS word, count(*) AS n FROM tok GROUP BY 1),
total AS (SELECT count(*) AS total FROM tok),
word_stats AS (
  SELECT word, r.lemma AS lemma, r.tags AS postag, n / total / k AS rate
  FROM by_word JOIN (SELECT form, len(readings) AS k, unnest(readings) AS r FROM byform) x ON x.form = by_word.word, total
)
"""
_RATE = "regexp_replace({0}, ':(xp[1-9]|up[0-9]{{2}}|comp.|predic|insert|vulg|coll|ns)', '', 'g')"
_CORE = "regexp_replace({0}, ':(arch|coll|slang|bad|vulg|up[0-9]{{2}}|ns)', '', 'g')"


def _ending(w: str, t: str) -> str:
    n = f"CASE WHEN regexp_matches({t}, '^(verb|advp):rev') THEN 5 WHEN {w}[-3] = '-' THEN 4 ELSE 3 END"
    return (
        f"CASE WHEN regexp_matches({t}, '^(noun|adj|verb|adv)') AND NOT contains({t}, ':nv') AND regexp_matches({w}, '[а-яіїєґ]\\z') "
        f"AND NOT regexp_matches({w}, '-(що|бо|то|от|но|таки)\\z') AND length({w}) > 3 AND length({w}) > ({n}) THEN right({w}, {n}) END"
    )


def _clean(expr: str) -> str:
    return f"SELECT request_id, md5({expr}) AS digest FROM clean_requests"


_L = f"[{T.UK}]"
_WA = f"{T.UK}a-zA-Z''’ʼ"
_SOFT = (
    f"regexp_replace(regexp_replace(regexp_replace(text, '([{_WA}][-–—‑]?)\\x{{AD}}+(\\n[ \\t]*)([-–—‑]?[{_WA}-]+)([,;.!?]?)', '\\1\\3\\4\\2', 'g'), "
    f"'([0-9])\\x{{AD}}+([{T.UK}a-zA-Z])', '\\1-\\2', 'g'), '([{_WA}:. ][-–—‑]?)\\x{{AD}}+([-–—‑]?[{_WA} -])', '\\1\\2', 'g')"
)
_LONE = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([^a-z])[,;–—-] a ({_L})', '\\1, а \\2', 'g'), '([^a-z]) i ({_L})', '\\1 і \\2', 'g'), '([^a-z]) o ({_L})', '\\1 о \\2', 'g'), '([^a-z]) y ({_L})', '\\1 у \\2', 'g')"
_LINES = "string_split(text, chr(10))"
_ALL_WORDS = f"SELECT source, doc_id, lower(unnest(regexp_extract_all(text, '[{LETTERS}]+'))) AS word FROM documents"


def oracle_sql() -> dict[str, str]:
    return {
        "paragraph_count": f"SELECT doc_id, len({_PARA}) AS n_paragraphs FROM documents",
        "paragraph_spans": f"SELECT doc_id, unnest({_PARA}) AS paragraph, generate_subscripts({_PARA}, 1) - 1 AS para_id FROM documents",
        "sentence_split": _SENTENCES + "SELECT doc_id, para_id, sent_id, sentence FROM sents",
        "sentence_length_stats": _SENTENCES + "SELECT source, count(*) AS n_sentences, round(avg(length(sentence)), 4) AS mean_length, max(length(sentence)) AS longest FROM sents GROUP BY source",
        "sentence_per_line": f"SELECT doc_id, len(list_filter({_LINES}, lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f\\x0B]'))) AS n_lines FROM documents",
        "word_tokenize_count": f"SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}')) AS n_tokens FROM documents",
        "tokens_with_space": f"SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}|{_S}+')) AS n_pieces, md5(replace(text, chr(9), ' ')) AS joined FROM documents",
        "only_words": f"""
            WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(replace(regexp_replace(text, '\\[[0-9]+\\]', '', 'g'), chr(769), ''), '{_TOKEN}'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')) AS w FROM documents)
            SELECT doc_id, array_to_string(flatten(list_transform(w, lambda x: CASE WHEN {_is_part('x')} THEN [regexp_extract(x, '{_PARTICLE}', 1), '-' || regexp_extract(x, '{_PARTICLE}', 2)] ELSE [x] END)), '|') AS words FROM w""",
        "particle_split": f"SELECT DISTINCT tok_value AS value, regexp_extract(tok_value, '{_PARTICLE}', 1) || '|-' || regexp_extract(tok_value, '{_PARTICLE}', 2) AS parts FROM tokens WHERE {_is_part('tok_value')}",
        "token_class_counts": _TAGGED + "SELECT kind AS class, count(*) AS n FROM t GROUP BY kind",
        "word_frequency": _SENTENCES
        + f"""SELECT lower(w) AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs
            FROM (SELECT doc_id, unnest(regexp_extract_all(sentence, '{_TOKEN}')) AS w FROM sents) WHERE regexp_matches(w, '^[{LETTERS}]+\\z') GROUP BY 1""",
        "word_frequency_by_source": f"SELECT source, word, count(*) AS n FROM ({_ALL_WORDS}) GROUP BY 1, 2",
        "streaming_word_count": f"SELECT word, count(*) AS n FROM ({_ALL_WORDS}) GROUP BY 1",
        "multi_column_route": "SELECT request_id FROM clean_requests WHERE regexp_matches(text, '[‑-]   +[а-яіїєґ]')",
        "dictionary_tagging": _TAGGED + "SELECT doc_id, para_id, sent_id, tok_id, value, len(readings) AS n_readings, readings[1].lemma AS lemma, readings[1].tags AS tags FROM tagged",
        "single_reading": _TAGGED + "SELECT string_split(readings[1].tags, ':')[1] AS pos, count(*) AS n FROM tagged GROUP BY 1",
        "known_word_semi": f"SELECT DISTINCT tok_value AS value FROM tokens WHERE {_known('tok_value')} IN (SELECT {_known('form')} FROM lexicon_uk WHERE form IS NOT NULL) OR lower({_known('tok_value')}) IN (SELECT {_known('form')} FROM lexicon_uk WHERE form IS NOT NULL)",
        "unknown_word_anti": f"SELECT DISTINCT tok_value AS value FROM tokens WHERE tok_value IS NOT NULL AND NOT ({_known('tok_value')} IN (SELECT {_known('form')} FROM lexicon_uk WHERE form IS NOT NULL) OR lower({_known('tok_value')}) IN (SELECT {_known('form')} FROM lexicon_uk WHERE form IS NOT NULL))",
        "class_counts": _TAGGED + f"SELECT count_if(readings[1].tags = 'unknown') AS unknown, count_if(readings[1].tags = 'unclass') AS unclass, count_if(readings[1].tags NOT IN ('unknown', 'unclass') AND {_CYR.format('value')}) AS known FROM tagged",
        "unknown_words": _TAGGED + "SELECT value, count(*) AS n FROM tagged WHERE readings[1].tags = 'unknown' AND lower(value) NOT IN (SELECT lower(form) FROM lexicon_ru WHERE form IS NOT NULL) GROUP BY value",
        "unknown_report": _TAGGED
        + f""", per AS (SELECT value, count_if(readings[1].tags = 'unknown') AS bad, count(*) AS n, regexp_matches(value, '^[а-яіїєґА-ЯІЇЄҐ''’ʼ]+\\z') AS letters FROM tagged WHERE {_CYR.format('value')} GROUP BY value),
            s AS (SELECT sum(n)::bigint AS total, sum(bad)::bigint AS bad, count(*) AS "distinct", count_if(bad > 0) AS bad_distinct, count_if(bad > 0 AND letters) AS bad_letters, count_if(letters) AS letters FROM per)
            SELECT total, bad, round(100.0 * bad / total, 2) AS pct, "distinct", bad_distinct, round(100.0 * bad_distinct / "distinct", 2) AS distinct_pct, round(100.0 * bad_letters / letters, 2) AS letters_pct FROM s""",
        "unknown_rate_by_document": _TAGGED
        + f""", c AS (SELECT doc_id, count_if(readings[1].tags = 'unknown') AS unknown, count_if(readings[1].tags NOT IN ('unknown', 'unclass') AND {_CYR.format('value')}) AS known FROM tagged GROUP BY doc_id)
            SELECT doc_id, coalesce(floor(unknown * 1000 / nullif(known + unknown, 0)), 0)::bigint AS per_mille, known FROM c""",
        "unclass_report": _TAGGED + "SELECT value, count(*) AS n FROM tagged WHERE readings[1].tags = 'unclass' GROUP BY value",
        "tagged_word_frequency": _TAGGED + f"SELECT CASE WHEN {_CAPITAL} THEN clean ELSE lower(clean) END AS word, count(*) AS n FROM tagged WHERE {_CYR.format('clean')} AND readings[1].tags <> '' AND readings[1].tags <> 'unclass' GROUP BY 1",
        "lemma_frequency": _TAGGED
        + f""", r AS (SELECT row_number() OVER () AS id, list_filter(readings, lambda x: x.tags IS NOT NULL AND x.tags NOT IN ('unknown', 'unclass') AND x.lemma <> '') AS r FROM tagged WHERE {_CYR.format('value')}),
            e AS (SELECT DISTINCT id, x.lemma AS lemma, string_split(x.tags, ':')[1] AS pos FROM (SELECT id, unnest(r) AS x FROM r)),
            l AS (SELECT id, count(DISTINCT lemma) AS k FROM e GROUP BY id)
            SELECT lemma, count(DISTINCT e.id) AS n, max(k > 1) AS ambiguous, string_agg(DISTINCT pos, ',' ORDER BY pos) AS pos FROM e JOIN l USING (id) GROUP BY lemma""",
        "homonym_groups": _TAGGED
        + f""", r AS (SELECT value, readings, list_filter(readings, lambda x: x.tags IS NOT NULL AND x.lemma <> '') AS r, {_CAPITAL} AS cap FROM tagged),
            h AS (SELECT array_to_string(list_transform(r, lambda x: x.lemma || '/' || x.tags), '|') AS homonym, CASE WHEN cap THEN value ELSE lower(value) END AS word, len(r) AS readings, len(list_distinct(list_transform(r, lambda x: x.lemma || '/' || string_split(x.tags, ':')[1]))) AS heads FROM r WHERE len(r) > 1)
            SELECT homonym, count(*) AS n, string_agg(DISTINCT word, ',' ORDER BY word) AS words, first(readings) AS readings, first(heads) AS heads FROM h GROUP BY homonym""",
        "merged_counts": "SELECT tok_value AS value, 2 * count(*) AS n FROM (SELECT DISTINCT * FROM tokens) GROUP BY tok_value",
        "clean_control_chars": _clean("regexp_replace(replace(text, chr(8206), ''), '[\\x{00}-\\x{08}\\x{0B}-\\x{12}\\x{14}-\\x{1F}\\x{0A0D}]', '', 'g')"),
        "clean_orphan_cr": _clean("replace(replace(replace(text, chr(13) || chr(10), chr(57345)), chr(13), chr(10)), chr(57345), chr(13) || chr(10))"),
        "clean_combining": _clean("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[іi]\\x{308}', 'ї', 'g'), '[ІI]\\x{308}', 'Ї', 'g'), 'и\\x{306}', 'й', 'g'), 'И\\x{306}', 'Й', 'g')"),
        "clean_apostrophes": _clean("regexp_replace(regexp_replace(text, '([бвгґдзкмнпрстфхшБВГҐДЗКМНПРСТФХШ])[\"”‟‘′\\x{313}\\x{384}\\x{92}´`?*]([єїюяЄЇЮЯ])', '\\1''\\2', 'g'), '[´`]([аеєиіїоуюяАЕЄИІЇОУЮЯ])', chr(769) || '\\1', 'g')"),
        "clean_soft_hyphens": _clean(_SOFT),
        "clean_line_separators": _clean("regexp_replace(text, '\\x{2028}\\n?', chr(10), 'g')"),
        "clean_lone_latin": _clean(_LONE),
        "clean_dos_newlines": "SELECT request_id, regexp_matches(text, '^[^\\n]*\\r\\n') AS dos FROM clean_requests",
        "homoglyph_translation": "SELECT DISTINCT form, translate(form, 'асеіорхуАВСЕНІКМОРТХУ', 'aceiopxyABCEHIKMOPTXY') AS latin, translate(translate(form, 'асеіорхуАВСЕНІКМОРТХУ', 'aceiopxyABCEHIKMOPTXY'), 'aceiopxyrABCEHIKMOPTXY', 'асеіорхугАВСЕНІКМОРТХУ') AS back FROM lexicon_uk",
        "quality_lines": f"""SELECT request_id, len(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '^[ \\t]*[-_–—~][ \\t]*[0-9]{{1,4}}[ \\t]*[-_–—~][ \\t]*\\z'))) AS page_numbers, len(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: length(x) > 4096)) AS long_lines,
            list_max(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: length(x))) AS longest, len(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '[{T.UK}''’ʼ]{{36}}'))) AS long_words FROM (SELECT request_id, coalesce(text, '') AS text FROM clean_requests)""",
        "word_count_gate": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^А-ЯІЇЄҐа-яіїєґё''’ʼ\\x{301}-]+'), lambda w: regexp_matches(w, '^[А-ЩЬЮЯІЇЄҐа-щьюяіїєґ][А-ЩЬЮЯІЇЄҐа-щьюяіїєґ''’ʼ\\x{301}-]+\\z'))) AS n_words FROM documents",
        "alphabet_gate": "WITH c AS (SELECT doc_id, length(regexp_replace(lower(text), '[^іїєґ]', '', 'g')) AS n_uk, length(regexp_replace(lower(text), '[^ыэъё]', '', 'g')) AS n_ru FROM documents) SELECT doc_id, n_uk, n_ru, n_uk >= 5 AND n_uk >= n_ru AS ok FROM c",
        "leftover_marks": f"""SELECT count_if(regexp_matches(text, '[\\x{{00}}-\\x{{08}}\\x{{0B}}-\\x{{12}}\\x{{14}}-\\x{{1F}}]')) AS has_control, count_if(regexp_matches(text, '[\\x{{E000}}-\\x{{F8FF}}]')) AS has_private, count_if(contains(text, chr(173))) AS has_soft_hyphen, count_if(contains(text, '¬')) AS has_not_sign,
            count_if(regexp_matches(text, '{_L}[a-zA-Z]|[a-zA-Z]{_L}')) AS has_mix, count_if(regexp_matches(text, '{_L}[-–‑¬][ \\t]*\\n')) AS has_wrap FROM clean_requests""",
        "tag_norm": f"SELECT DISTINCT tags, {_RATE.format('tags')} AS rate_tags, {_CORE.format('tags')} AS core_tags, string_split(tags, ':')[1] AS pos FROM lexicon_uk WHERE tags IS NOT NULL",
        "word_ending": f"SELECT DISTINCT form, tags, {_ending('form', 'tags')} AS ending FROM lexicon_uk WHERE form IS NOT NULL AND tags IS NOT NULL",
        "number_norm": """SELECT DISTINCT tok_value AS value, CASE WHEN regexp_matches(tok_value, '^(?:(?:1[6789]|20)[0-9]{2}[-–—])?(?:1[6789]|20)([0-9]{2})\\z') THEN 'YY' || right(tok_value, 2)
            WHEN regexp_matches(replace(tok_value, ' ', ''), '^(?:[0-9]+[-—–])?[0-9]+\\z') THEN CASE WHEN regexp_matches(tok_value, '([05-9]|1[0-9])\\z') THEN '0' WHEN regexp_matches(tok_value, '[234]\\z') THEN '2' ELSE '1' END
            WHEN regexp_matches(replace(tok_value, ' ', ''), '^(?:[0-9,]+[–—-])?[0-9]+[,.][0-9]+\\z') THEN '0,0' END AS norm FROM tokens WHERE regexp_matches(tok_value, '^[0-9]')""",
        "mark_norm": _TAGGED + "SELECT CASE WHEN value = '...' THEN '…' WHEN value IN ('–', '—') THEN '-' WHEN value = '„' THEN '«' WHEN value = '“' THEN '»' WHEN regexp_matches(value, '^[?!]\\.+\\z') THEN value[1] ELSE value END AS mark, count(*) AS n FROM t WHERE kind = 'punct' GROUP BY 1",
        "tag_stats_normalised": _TAGGED + _STATS + f", g AS (SELECT {_RATE.format('postag')} AS tags, sum(rate) AS rate FROM word_stats GROUP BY 1) SELECT tags, round(rate / sum(rate) OVER (), 6) AS share FROM g",
        "suffix_stats": _TAGGED + _STATS + f", e AS (SELECT {_ending('word', 't')} AS suffix, t AS tags, rate FROM (SELECT word, {_RATE.format('postag')} AS t, rate FROM word_stats)) SELECT suffix, tags, round(sum(rate), 8) AS rate FROM e WHERE suffix IS NOT NULL GROUP BY 1, 2",
        "reading_rank": _TAGGED
        + _STATS
        + f""", x AS (SELECT doc_id, para_id, sent_id, tok_id, clean, tagged.value AS v, lower({_known('coalesce(clean, value)')}) AS value, unnest(readings) AS r, generate_subscripts(readings, 1) AS reading_id FROM tagged WHERE len(readings) > 1),
            y AS (SELECT x.*, coalesce(s.rate, 0.0) AS rate FROM x LEFT JOIN word_stats s ON s.word = x.value AND s.lemma = x.r.lemma AND s.postag = x.r.tags),
            z AS (SELECT value, r.lemma AS lemma, r.tags AS tags, row_number() OVER (PARTITION BY doc_id, para_id, sent_id, tok_id ORDER BY rate DESC, reading_id) AS rank, round(CASE WHEN sum(rate) OVER (PARTITION BY doc_id, para_id, sent_id, tok_id) > 0 THEN rate / sum(rate) OVER (PARTITION BY doc_id, para_id, sent_id, tok_id) ELSE 0.0 END, 3) AS confidence FROM y)
            SELECT value, lemma, tags, rank, confidence, count(*) AS n FROM z GROUP BY ALL""",
        "prev_next_context": _TAGGED
        + """, w AS (SELECT value, coalesce(lag(value) OVER o, '__BEG') AS "left", CASE WHEN row_number() OVER o < count(*) OVER (PARTITION BY doc_id, para_id, sent_id) - 1 THEN lead(value) OVER o ELSE '__END' END AS "right" FROM tok WINDOW o AS (PARTITION BY doc_id, para_id, sent_id ORDER BY tok_id))
            SELECT value, "left", "right", count(*) AS n FROM w GROUP BY ALL""",
        "space_after": _TAGGED + ", w AS (SELECT value, lead(whitespace_before) OVER (PARTITION BY doc_id, para_id, sent_id ORDER BY tok_id) AS space_after FROM tok) SELECT value, space_after, count(*) AS n FROM w GROUP BY ALL",
        "syllable_count": "SELECT DISTINCT form, length(regexp_replace(form, '[^аеєиіїоуюяАЕЄИІЇОУЮЯ]', '', 'g')) AS n FROM lexicon_uk WHERE form IS NOT NULL",
        "stress_key": "SELECT DISTINCT tags, regexp_replace(regexp_replace(replace(tags, ':inanim', ''), '^(noun(?::(?:un)?anim)?:[mnfps]|(?:noun(?::(?:un)?anim)?).*&pron|verb(?::perf|:imperf)+|adj(?:.*?:&adjp)?|[a-z]+).*\\z', '\\1'), 'adj.*?:&adjp', 'adj:&adjp') AS tag_key FROM lexicon_uk WHERE tags IS NOT NULL",
        "inflect_genitive": "SELECT lemma, string_agg(DISTINCT form, ',' ORDER BY form) AS forms FROM lexicon_uk WHERE regexp_matches(tags, '^(?:noun:inanim:.:v_rod.*)\\z') GROUP BY lemma",
        "documents_rollup": "SELECT lang, source, count(*) AS n, sum(n_chars)::bigint AS n_chars, grouping(lang, source)::int AS level FROM documents GROUP BY ROLLUP (lang, source)",
    }
