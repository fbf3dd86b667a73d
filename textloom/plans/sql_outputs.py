r"""SQL for DuckDB of the queries on outputs, languages, guesses and rules."""

from textloom.functions import tokenize as T
from textloom.operators import quality as G
from textloom.operators.ortho import LESYA
from textloom.plans import queries as Q
from textloom.plans.sql import _CYR as _CYRILLIC
from textloom.plans.sql import _LONE, _PARTICLE, _RATE, _S, _SENTENCES, _STATS, _TAGGED, _TOKEN, _ending, _is_part, _known

_KEYS = "doc_id, para_id, sent_id"
_ORDER = "tok_id, value, clean NULLS FIRST, whitespace_before NULLS FIRST"
# one row for each token, with its place in the sentence
_PLACED = _TAGGED + f", placed AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY {_ORDER}) AS i FROM tagged)"


def _esc(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_GLUED = "r.tags = 'punct' AND NOT coalesce(whitespace_before, true)"


def _by_document(sentence: str, between: str, head: str = "''", tail: str = "''") -> str:
    return (
        f", sents AS (SELECT {_KEYS}, {sentence} AS s FROM placed GROUP BY {_KEYS}) "
        f"SELECT doc_id, {head} || string_agg(s, {between} ORDER BY para_id, sent_id, s) || {tail} AS body FROM sents GROUP BY doc_id"
    )


_VERTICAL = _PLACED + _by_document(
    "'<s>' || chr(10) || string_agg(CASE WHEN i > 1 AND readings[1].tags = 'punct' AND NOT coalesce(whitespace_before, false) THEN '<g/>' || chr(10) ELSE '' END || value || chr(9) || readings[1].tags || chr(9) || readings[1].lemma"
    " || array_to_string(list_transform(readings[2:], lambda r: ' || ' || r.tags || ' ' || r.lemma), '') || chr(10), '' ORDER BY i) || '</s>' || chr(10)",
    "''",
)
_JSON_READING = "'{\"value\":' || to_json(value)::VARCHAR || ',\"lemma\":' || to_json(r.lemma)::VARCHAR || ',\"tags\":' || to_json(r.tags)::VARCHAR || CASE WHEN " + _GLUED + " THEN ',\"whitespaceBefore\":false' ELSE '' END || '}'"
_JSON = _PLACED + _by_document(
    f"'{{\"tokenReadings\":[' || string_agg('{{\"tokens\":[' || array_to_string(list_transform(readings, lambda r: {_JSON_READING}), ',') || ']}}', ',' ORDER BY i) || ']}}'",
    "',' || chr(10)",
    "'{\"sentences\": [' || chr(10)",
    "chr(10) || ']}' || chr(10)",
)


def _xml_token(close: str) -> str:
    return f"""'<token value="' || {_esc('value')} || '" lemma="' || {_esc('r.lemma')} || '" tags="' || {_esc('r.tags')} || '"' || CASE WHEN {_GLUED} THEN ' whitespaceBefore="false"' ELSE '' END || '{close}' || chr(10)"""


_XML_ALTS = f"'    <alts>' || chr(10) || array_to_string(list_transform(readings[2:], lambda r: '      ' || {_xml_token(' />')}), '') || '    </alts>' || chr(10)"
_XML_FIRST = lambda close: f"list_transform(readings[1:1], lambda r: {_xml_token(close)})[1]"
_XML = _PLACED + _by_document(
    f"'<sentence>' || chr(10) || string_agg('  ' || CASE WHEN len(readings) > 1 THEN {_XML_FIRST('>')} || {_XML_ALTS} || '  </token>' || chr(10) ELSE {_XML_FIRST(' />')} END, '' ORDER BY i) || '</sentence>' || chr(10)",
    "''",
    "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<text>' || chr(10)",
    "'</text>' || chr(10)",
)
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dict(Q.UD_PARTS).items() if k != "numr") + "}"
_NEG = ", ".join(f"'{w}'" for w in Q.NEGATIVES)
_get = lambda k: f"map_extract({_MAP}, {k})[1]"
_POS_KEY = "regexp_extract({0}, '^(noun(?::(?:un|in)?anim)?|adj)', 1)"
_UD = (
    _TAGGED
    + f""", genders AS (
  SELECT lemma, {_POS_KEY.format('tags')} AS pos_key, min(CASE regexp_extract(tags, ':([mfn]):v_naz', 1) WHEN 'm' THEN 1 WHEN 'f' THEN 2 ELSE 3 END) AS g
  FROM lexicon_uk WHERE regexp_matches(tags, '^(noun|adj).*:[mfn]:v_naz') GROUP BY 1, 2),
u0 AS (SELECT *, readings[1].lemma AS lemma, readings[1].tags AS tags, lead(whitespace_before) OVER (PARTITION BY {_KEYS} ORDER BY tok_id) AS space_after FROM tagged),
u1 AS (SELECT u0.*, CASE WHEN regexp_matches(tags, '^(noun|adj).*:p:v_') AND NOT (starts_with(u0.lemma, 'пів') AND contains(tags, 'nv:up92')) THEN CASE g WHEN 1 THEN 'Gender=Masc' WHEN 2 THEN 'Gender=Fem' WHEN 3 THEN 'Gender=Neut' END END AS gender,
  list_filter(string_split(replace(replace(tags, 'conj:', 'conj+'), 'noninfl:predic', 'noninfl+predic'), ':'), lambda p: NOT regexp_matches(p, '^(xp[0-9]|pron|predic|insert)$')) AS parts
  FROM u0 LEFT JOIN genders ON genders.lemma = u0.lemma AND genders.pos_key = {_POS_KEY.format('u0.tags')}),
u2 AS (SELECT *, string_split({_get("replace(parts[1], '+', ':')")}, '; ') AS head,
  list_filter(list_transform(parts[2:], lambda p: regexp_replace({_get("CASE WHEN p = 'obsc' THEN 'vulg' ELSE p END")}, 'Gender=(Masc|Fem|Neut)', '\\0; Number=Sing', 'g')), lambda u: u IS NOT NULL AND u <> '-') AS rest FROM u1),
u3 AS (SELECT *, list_concat(rest, coalesce(head[2:], [])) AS all_, regexp_replace(head[1], '^Upos=', '') AS pos FROM u2),
u4 AS (SELECT *, CASE WHEN list_contains(all_, 'Upos=PROPN') THEN 'PROPN' WHEN pos = 'NOUN' AND list_contains(all_, 'PronType=Prs') THEN 'PRON' ELSE coalesce(pos, '_') END AS upos,
  list_filter(list_distinct(flatten(list_transform(list_concat(list_filter(all_, lambda u: u <> 'Upos=PROPN'), list_filter([CASE WHEN lemma IN ({_NEG}) THEN 'Polarity=Neg' END, CASE WHEN starts_with(tags, 'verb') AND NOT regexp_matches(tags, ':inf|:impers') THEN 'VerbForm=Fin' END, gender], lambda u: u IS NOT NULL)),
    lambda u: list_transform(regexp_split_to_array(trim(u), '; |\\|'), lambda x: trim(x))))), lambda u: u <> 'VerbForm=Fin' OR starts_with(tags, 'verb')) AS f FROM u3),
u5 AS (SELECT *, list_transform(list_sort(list_transform(f, lambda u: {{'k': lower(u), 'u': u}})), lambda x: x.u) AS g FROM u4),
u6 AS (SELECT *, array_to_string(list_filter(g, lambda u: u <> 'Uninflect=Yes'), '|') AS s0, array_to_string(list_filter([CASE WHEN list_contains(g, 'Uninflect=Yes') THEN 'Uninflect=Yes' END, CASE WHEN NOT space_after THEN 'SpaceAfter=No' END], lambda u: u IS NOT NULL), '|') AS m0 FROM u5),
ud AS (SELECT *, coalesce(nullif(CASE WHEN starts_with(tags, 'noun') THEN replace(s0, 'NumType=Ord', 'NumType=Card') ELSE s0 END, ''), '_') AS feats, coalesce(nullif(m0, ''), '_') AS misc FROM u6)
"""
)
_CONLLU = (
    _UD
    + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY tok_id, value, lemma, upos, tags, feats, misc) AS i, CASE WHEN coalesce(whitespace_before, true) THEN ' ' ELSE '' END || value AS spoken FROM ud)
SELECT {_KEYS}, '# sent_id = ' || (sent_id + 1) || chr(10) || '# text = ' || trim(string_agg(spoken, '' ORDER BY tok_id, spoken)) || chr(10)
  || string_agg(concat_ws(chr(9), i::VARCHAR, value, lemma, upos, tags, feats, '_', '_', '_', misc), chr(10) ORDER BY i) || chr(10) AS conllu FROM numbered GROUP BY {_KEYS}"""
)
_CYR = "[а-яіїєґёА-ЯІЇЄҐЁ]"


def _in(lang: str, where: str = "") -> str:
    f = f"SELECT {_known('form')} FROM lexicon_{lang} WHERE form IS NOT NULL{where}"
    return f"({_known('word')} IN ({f}) OR lower({_known('word')}) IN ({f}))"


_WEAK = " AND (tags IS NULL OR NOT regexp_matches(tags, ':(bad|subst)'))"
_RATES = f"""
WITH chunks AS (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS pos FROM (
  SELECT doc_id, string_split(text, CASE WHEN regexp_matches(text, '[^\\s]\\n\\n+[^\\s]') THEN chr(10) || chr(10) ELSE chr(10) END) AS c FROM documents)),
w AS (SELECT doc_id, pos, chunk, list_filter(list_transform(regexp_extract_all(chunk, '[а-яіїєґёА-ЯІЇЄҐЁ''’ʼ\\x{{301}}-]+'), lambda x: regexp_replace(x, '^[''’ʼ]+|[''’ʼ]+$', '', 'g')), lambda x: regexp_matches(x, '{_CYR}')) AS w FROM chunks),
e AS (SELECT doc_id, pos, regexp_matches(chunk, '[ыэъё]') AS has_ru, regexp_matches(chunk, '[ієїґ]') AS has_uk, len(w) AS n, unnest(w) AS word FROM w),
d AS (SELECT DISTINCT word FROM e),
k AS (SELECT word, lower(word) AS low, CASE WHEN regexp_matches(lower(word), '[іїєґ''’ʼ]|^й$') THEN 10 WHEN {_in('uk', _WEAK)} THEN 8 WHEN {_in('uk')} THEN 2 ELSE 0 END AS uk, {_in('ru')} AS in_ru FROM d),
x AS (SELECT word, uk, CASE WHEN uk = 10 THEN 0 WHEN regexp_matches(low, '^[бвгдежзклмнпрстфхцчшщю]$') THEN 0 WHEN regexp_matches(low, '[ыэёъ]') THEN 10 WHEN in_ru THEN 8 ELSE 0 END AS ru FROM k),
g AS (SELECT doc_id, pos, has_ru, has_uk, n, sum(uk) / count(*) / 10 AS uk_rate, sum(ru) / count(*) / 10 AS ru_rate, bool_or(uk = 10) AS sure_uk, bool_or(ru = 10) AS sure_ru FROM e JOIN x USING (word) GROUP BY ALL),
rates AS (SELECT doc_id, pos, CASE WHEN n < 10 AND (NOT has_ru OR has_uk) THEN 0.5 ELSE uk_rate END AS uk_rate,
  CASE WHEN n < 10 AND (NOT has_ru OR has_uk) THEN 0.1 WHEN sure_ru AND NOT sure_uk OR uk_rate = 0 AND ru_rate > 0.1 THEN 1.0 ELSE ru_rate END AS ru_rate FROM g)
"""
_WORDS = f"len(regexp_extract_all(text, '[{Q.LETTERS}]+'))"
# runs of one word and blanks: every two of it are a match
_REPEATED = r"""
pieces AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+|[^\p{L}]') AS p FROM documents)),
words AS (SELECT doc_id, i, lower(p) AS w, length(p) > 1 AND regexp_matches(p, '^\p{L}') AS ok FROM pieces WHERE p IS NOT NULL),
spaced AS (SELECT a.doc_id, a.i, a.w, a.ok AND EXISTS (SELECT 1 FROM words b WHERE b.doc_id = a.doc_id AND b.i = a.i - 1 AND b.w = ' ') AND EXISTS (SELECT 1 FROM words b WHERE b.doc_id = a.doc_id AND b.i = a.i - 2 AND b.w = a.w) AS again FROM words a WHERE ok),
runs AS (SELECT doc_id, i, again, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM spaced),
repeated AS (SELECT doc_id, run, count(*) // 2 AS n FROM runs GROUP BY 1, 2 HAVING count(*) > 1)
"""
_SUFFIX_STATS = f"""
, forms AS (SELECT DISTINCT form, lemma, tags FROM lexicon_uk WHERE form IS NOT NULL AND lemma IS NOT NULL AND tags IS NOT NULL AND length(form) >= 6),
same AS (SELECT *, len(list_filter(range(1, least(length(form), length(lemma)) + 1), lambda k: form[1:k] = lemma[1:k])) AS same FROM forms),
ends_ AS (SELECT right(form, CASE WHEN ends_with(form, 'ться') THEN 6 ELSE 4 END) AS suffix, lemma[same + 1:] || '/' || (length(form) - same) AS add_del, tags AS postag, count(*) AS cnt FROM same GROUP BY 1, 2, 3),
placed AS (SELECT value, readings[1].tags AS tag, row_number() OVER o = 1 AS first, lag(readings[1].lemma) OVER o AS left_lemma, lag(readings[1].tags) OVER o AS left_tags FROM tagged WINDOW o AS (PARTITION BY {_KEYS} ORDER BY tok_id, value)),
asked AS (SELECT DISTINCT concat_ws('|', value, first::VARCHAR, left_lemma, left_tags) AS key, value, first, left_lemma, left_tags FROM placed WHERE tag = 'unknown'),
short AS (SELECT *, regexp_matches(value, '^[А-ЯІЇЄҐ]+-[0-9]+[а-яіїєґА-ЯІЇЄҐ]*$') AS numbered, regexp_matches(value, '^[А-ЯІЇЄҐ]{{2,6}}$') AS capitals FROM asked),
rest AS (SELECT *, regexp_extract(value, '^([А-ЯІЇЄҐA-Z0-9]+[-–])([а-яіїєґ].*)$', 1) AS pre, CASE WHEN regexp_matches(value, '^([А-ЯІЇЄҐA-Z0-9]+[-–])([а-яіїєґ].*)$') THEN regexp_extract(value, '^([А-ЯІЇЄҐA-Z0-9]+[-–])([а-яіїєґ].*)$', 2) ELSE value END AS w FROM short WHERE NOT numbered AND NOT capitals),
cand AS (SELECT rest.*, add_del, postag, string_split(add_del, '/')[1] AS add_, string_split(add_del, '/')[2]::INT AS del, contains(postag, 'prop') AS proper, regexp_extract(postag, ':([mf]):', 1) AS gender, cnt FROM rest JOIN ends_ ON ends_.suffix = right(w, CASE WHEN ends_with(w, 'ться') THEN 6 ELSE 4 END) AND length(w) >= CASE WHEN ends_with(w, 'ться') THEN 8 ELSE 6 END),
weighed AS (SELECT *, CASE WHEN proper AND NOT regexp_matches(w, '^[А-ЯІЇЄҐA-Z]') THEN 0
  WHEN proper AND NOT first AND contains(postag, 'lname') AND (coalesce(CASE gender WHEN 'm' THEN regexp_matches(left_lemma, '^(?:пан|містер|гер|сеньйор|монсеньйор|добродій|князь)$') WHEN 'f' THEN regexp_matches(left_lemma, '^(?:пані|міс|місіс|княгиня|фрау|сеньора|сеньйоріта|мадам|маде?муазель|добродійка)$') END, false)
    OR coalesce(contains(left_tags, 'fname') AND regexp_extract(left_tags, ':([mf]):', 1) = gender AND gender <> '', false)) THEN cnt * 10000
  WHEN proper AND NOT first THEN cnt * 100 WHEN proper AND regexp_matches(w, '[а-яіїєґ]-[А-ЯІЇЄҐ][а-яіїєґ'']') THEN cnt * 100 ELSE cnt END AS weight FROM cand),
kept AS (SELECT * FROM weighed WHERE weight > 0 AND length(w) >= del + 2)
SELECT key, value, 1 AS rank, value AS lemma, CASE WHEN numbered THEN 'noninfl' ELSE 'noninfl:abbr' END AS tags, -0.7::DOUBLE AS confidence FROM short WHERE numbered OR capitals
UNION ALL SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY weight DESC, postag, add_del), pre || CASE WHEN contains(postag, ':prop') THEN w[1:length(w) - del] || add_ ELSE lower(w[1:length(w) - del] || add_) END, postag,
  CASE WHEN count(*) OVER (PARTITION BY key) > 1 THEN -0.5 ELSE -0.6 END::DOUBLE FROM kept
"""


def _attempt(word: str, pairs: list) -> str:
    for a, b in pairs:
        a, b = a.replace("(?iu)", ""), b.replace("$", "\\")
        if "\\1" in a:  # no backreferences here
            for c in "ндтч":
                word = f"regexp_replace({word}, '{c}{c}ів$', '{c}ь', 'g')"
        else:
            word = f"regexp_replace({word}, '{a}', '{b}', 'g')"
    return word


_OLDER = (
    _TAGGED
    + ", asked AS (SELECT value, lower(value) AS low FROM tagged WHERE readings[1].tags = 'unknown' UNION SELECT regexp_replace(form, '(.)и', '\\1і', 'g'), lower(regexp_replace(form, '(.)и', '\\1і', 'g')) FROM lexicon_uk WHERE form IS NOT NULL)"
    + ", tries AS (" + " UNION ALL ".join([f"SELECT value, {k} AS no, {_attempt('low', pairs)} AS form, low FROM asked" for k, pairs in enumerate([[], *LESYA])]) + ")"
    + f""", hits AS (SELECT value, no, len(readings) AS n FROM tries JOIN byform USING (form) WHERE (no = 0 OR tries.form <> low) AND (no < {len(LESYA)} OR len(list_filter(readings, lambda r: contains(r.tags, ':m:v_rod'))) > 0))
SELECT value, arg_min(n, no) AS n_readings FROM hits GROUP BY value"""
)
_NOT_WORD = r"(?:[^\p{L}\p{N}_]|$)"
_BROKEN = "[ \\t-](?:(?:" + G.BROKEN[G.BROKEN.index("(?:") + 3 : G.BROKEN.rindex(")(?!")].replace("обов(?!['’ʼ])|", "") + ")" + _NOT_WORD + "|обов(?:[^\\p{L}\\p{N}_''’ʼ]|$))"
_LINES = "regexp_split_to_array(text, '\\r?\\n')"
_N = lambda p: f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '{p}')))"
_U = f"[{T.UK}]"
_DIAGNOSTICS = f"""
WITH n AS (SELECT request_id, unnest(list_filter([
  CASE WHEN {_N('^[ \\t]*[-_–—~][ \\t]*[0-9]{1,4}[ \\t]*[-_–—~][ \\t]*$')} >= 3 THEN 'page_numbers' END,
  CASE WHEN len(list_filter({_LINES}, lambda x: length(x) > 4096)) > 0 THEN 'long_lines' END,
  CASE WHEN {_N(f"[{T.UK}''’ʼ]{{36}}")} > 0 THEN 'long_words' END,
  CASE WHEN {_N(_BROKEN)} > 5 THEN 'broken_words' END,
  CASE WHEN len(regexp_extract_all(text, '\\n\\n')) > 5 AND regexp_matches(regexp_replace(text, '^[^\\n]*\\n[^\\n]*\\n', ''), '[{T.UK},:—–-]\\s*\\n\\n[а-яіїєґ]') THEN 'empty_lines' END,
  CASE WHEN regexp_matches(text, '[\\x{{00}}-\\x{{08}}\\x{{0B}}-\\x{{12}}\\x{{14}}-\\x{{1F}}]') THEN 'control' END,
  CASE WHEN regexp_matches(text, '[\\x{{E000}}-\\x{{F8FF}}]') THEN 'private' END, CASE WHEN contains(text, chr(173)) THEN 'soft_hyphen' END, CASE WHEN contains(text, '¬') THEN 'not_sign' END,
  CASE WHEN regexp_matches(text, '{_U}[a-zA-Z]|[a-zA-Z]{_U}') THEN 'mix' END, CASE WHEN regexp_matches(text, '{_U}[-–‑¬][ \\t]*\\n') THEN 'wrap' END], lambda x: x IS NOT NULL)) AS note FROM clean_requests)
SELECT note, count(*) AS n FROM n GROUP BY note"""
_LAID_OUT = "array_to_string(list_transform(string_split(lower(text), chr(10)), lambda x: rpad(regexp_replace(x, '[^а-яіїєґ]+', '', 'g')[1:10], 16, ' ') || regexp_replace(x, '[^а-яіїєґ]+', '', 'g')[11:20]), chr(10))"
_COLUMNS = f"""
WITH t AS (SELECT request_id, {_LAID_OUT} AS text FROM clean_requests WHERE text IS NOT NULL),
l AS (SELECT request_id, len(string_split(text, chr(10))) AS n, length(text) - length(replace(text, '    ', '   ')) AS gaps, list_transform(regexp_extract_all(text, '(?im)(.*?[а-яїієґ] {{4,}})[а-яіїєґ].{{4}}', 1), lambda x: length(x)) AS w FROM t)
SELECT request_id FROM l WHERE gaps >= 5 AND len(w) >= 5 AND len(w) > (n - 1) * 0.75 AND list_min(w[1:5]) = list_max(w[1:5])"""
_WORDS_OF = f"flatten(list_transform(regexp_extract_all(sentence, '{_TOKEN}'), lambda x: CASE WHEN {_is_part('x')} THEN [regexp_extract(x, '{_PARTICLE}', 1), '-' || regexp_extract(x, '{_PARTICLE}', 2)] ELSE [x] END))"


def oracle_sql() -> dict[str, str]:
    return {
        "tokenizer_json": _SENTENCES
        + f""", w AS (SELECT doc_id, para_id, sent_id, to_json({_WORDS_OF})::VARCHAR AS w FROM sents)
            SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE '[' || coalesce(string_agg(w.w, ',' ORDER BY para_id, sent_id), '') || ']' END AS body FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id, d.text""",
        "diagnostics": _DIAGNOSTICS,
        "two_columns": _COLUMNS,
        "multi_column_route": "SELECT request_id FROM clean_requests WHERE regexp_matches(replace(text, '-', '-    '), '[‑-]   +[а-яіїєґ]')",
        "particle_split": f"WITH v AS (SELECT tok_value AS value FROM tokens UNION SELECT tok_value || '-но' FROM tokens UNION SELECT tok_value || '–таки' FROM tokens) SELECT value, regexp_extract(value, '{_PARTICLE}', 1) || '|-' || regexp_extract(value, '{_PARTICLE}', 2) AS parts FROM v WHERE {_is_part('value')}",
        "despaced": "SELECT DISTINCT form, form AS result FROM lexicon_uk WHERE regexp_matches(form, '^[а-яіїєґ]{5,}$')",
        "older_spelling": _OLDER,
        "unknown_suffix_guess": _TAGGED + _SUFFIX_STATS,
        "dependencies": _UD + "SELECT upos, feats, count(*) AS n FROM ud GROUP BY 1, 2",
        "vertical_output": _VERTICAL,
        "json_output": _JSON,
        "xml_output": _XML,
        "conllu_output": _CONLLU,
        "language_rates": _RATES + "SELECT doc_id, pos, round(uk_rate, 4)::DOUBLE AS uk_rate, round(ru_rate, 4)::DOUBLE AS ru_rate FROM rates",
        "language_marks": _RATES + "SELECT doc_id, count(*)::INT AS n_marks FROM rates WHERE uk_rate < ru_rate GROUP BY doc_id",
        "russian_chunks": _RATES + "SELECT doc_id, pos, md5(chunk) AS chunk, round(ru_rate, 2)::DOUBLE AS rate FROM rates JOIN chunks USING (doc_id, pos) WHERE uk_rate < ru_rate",
        "rule_matches": "WITH " + _REPEATED + r"""SELECT * FROM (SELECT 'REPEATED_WORD' AS rule_id, sum(n)::BIGINT AS n FROM repeated
            UNION ALL SELECT 'COMMA_SPACE', sum(len(regexp_extract_all(text, '\p{L},\p{L}')))::BIGINT FROM documents UNION ALL SELECT 'THREE_MARKS', sum(len(regexp_extract_all(text, '!!!')))::BIGINT FROM documents) WHERE n > 0""",
        "grammar_rating": rf"""WITH c AS (SELECT doc_id, {_WORDS} AS n_words, len(regexp_extract_all(text, '\p{{L}},\p{{L}}')) AS a, len(regexp_extract_all(text, '!!!')) AS b FROM documents)
            SELECT doc_id, round((a + b) * 10000 / n_words) / 100 AS rating, (a > 0)::BIGINT + (b > 0)::BIGINT AS rules FROM c WHERE n_words > 0""",
    }


_CONTROLS = "regexp_replace(text, '[\\x{00}-\\x{08}\\x{0B}-\\x{12}\\x{14}-\\x{1F}\\x{0A0D}]', '', 'g')"
_CLEANED_SENTENCES = _SENTENCES.replace("FROM documents)", f"FROM (SELECT doc_id, source, {_CONTROLS} AS text FROM documents))", 1)
_LEX = _TAGGED[_TAGGED.index("lex AS (") : _TAGGED.index("t AS (SELECT *,")]
_KIND = _TAGGED[_TAGGED.index("t AS (SELECT *,") : _TAGGED.index("AS kind FROM tok)")]
_RAW = "unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS tok_id"


def _document_tokens(sents: str, split: bool, lemma: bool) -> str:
    """Tokens of documents with readings; ``sents`` are CTEs that end in ``sents``."""
    value = f"regexp_replace(raw, '^{_S}+', '')"
    parts = f"CASE WHEN {_is_part('value')} THEN [regexp_extract(value, '{_PARTICLE}', 1), '-' || regexp_extract(value, '{_PARTICLE}', 2)] ELSE [value] END" if split else "[value]"
    return (
        sents
        + f""", raw AS (SELECT doc_id, para_id, sent_id, {_RAW} FROM (SELECT *, regexp_extract_all(sentence, '{_S}*(?:{_TOKEN})') AS r FROM sents)),
whole AS (SELECT doc_id, para_id, sent_id, tok_id, {value} AS value FROM raw),
tok AS (SELECT doc_id, para_id, sent_id, tok_id, unnest(p) AS value, generate_subscripts(p, 1) - 1 AS part_no, CASE WHEN len(p) > 1 THEN unnest(p) ELSE {_known('value')} END AS clean FROM (SELECT *, {parts} AS p FROM whole)),
{_LEX}{_KIND}AS kind FROM tok),
tagged AS (SELECT t.*, CASE WHEN part_no > 0 THEN [{{'lemma': regexp_replace(t.value, '^-', ''), 'tags': 'part'}}] WHEN t.value <> '—' AND a.readings IS NOT NULL THEN a.readings WHEN t.value <> '—' AND b.readings IS NOT NULL THEN b.readings
  ELSE [{{'lemma': CASE WHEN t.kind = 'unknown' AND NOT {str(lemma).lower()} THEN '' ELSE coalesce(t.clean, t.value) END, 'tags': t.kind}}] END AS readings
  FROM t LEFT JOIN byform a ON a.form = t.f LEFT JOIN byform b ON b.form = lower(t.f))
"""
    )


_LINE_SENTENCES = _SENTENCES[: _SENTENCES.index("m AS (")].rstrip().rstrip(",") + ", l AS (SELECT doc_id, para_id, list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f\\x0B]')) AS s FROM p), sents AS (SELECT doc_id, para_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_id FROM l)"
_VOW = "аеєиіїоуюяАЕЄИІЇОУЮЯ"
_KEY_OF = "regexp_replace(regexp_replace(replace({0}, ':inanim', ''), '^(noun(?::(?:un)?anim)?:[mnfps]|(?:noun(?::(?:un)?anim)?).*&pron|verb(?::perf|:imperf)+|adj(?:.*?:&adjp)?|[a-z]+).*\\z', '\\1'), 'adj.*?:&adjp', 'adj:&adjp')"
# an entry's accent lies on its first vowel of either case, but only small vowels are counted
_STRESSED = (
    _TAGGED
    + f""", entries AS (SELECT DISTINCT lemma, {_KEY_OF.format('tags')} AS tag_key, lower(form) AS low FROM lexicon_uk WHERE form IS NOT NULL AND lemma IS NOT NULL AND tags IS NOT NULL AND regexp_matches(form, '[{_VOW}]')),
v AS (SELECT DISTINCT value, readings FROM tagged),
ask AS (SELECT value, unnest(readings) AS r FROM v WHERE length(regexp_replace(value, '[^{_VOW}]', '', 'g')) > 1 AND NOT contains(value, chr(769))),
hit AS (SELECT DISTINCT value FROM ask JOIN entries ON entries.lemma = r.lemma AND tag_key = {_KEY_OF.format('r.tags')} AND low = lower(value)),
stressed AS (SELECT DISTINCT v.value, CASE WHEN hit.value IS NULL THEN v.value ELSE regexp_replace(v.value, '^([^{_VOW}]*[{_VOW}])', '\\1' || chr(769)) END AS stressed FROM v LEFT JOIN hit ON hit.value = v.value)
"""
)
_ALLOWED = """CASE WHEN contains(tags, 'pron') THEN regexp_matches(semtag, ':deictic|:quantif') WHEN NOT starts_with(tags, 'noun') THEN true
  WHEN contains(tags, ':anim') AND contains(tags, 'name') THEN regexp_matches(semtag, ':hum|:supernat') WHEN contains(tags, ':anim') THEN regexp_matches(semtag, ':hum|:supernat|:animal|:org') WHEN contains(tags, ':unanim') THEN contains(semtag, ':animal')
  WHEN regexp_matches(lemma, '^[А-ЯІЇЄҐA-Z]') AND contains(tags, ':geo') THEN contains(semtag, ':loc') ELSE contains(semtag, ':hum:group') OR NOT regexp_matches(semtag, ':hum|:supernat|:animal') END"""


_FILES = "SELECT doc_id, md5(regexp_replace(text, '[\\n\\r]', ' ', 'g')) AS digest FROM documents WHERE text IS NOT NULL"


def more_sql() -> dict[str, str]:
    return {
        "document_tagging": _document_tokens(_CLEANED_SENTENCES, True, False) + "SELECT doc_id, para_id, sent_id, tok_id, part_no, value, len(readings)::INT AS n_readings, readings[1].lemma AS lemma, readings[1].tags AS tags FROM tagged",
        "line_tagging": _document_tokens(_LINE_SENTENCES, False, True) + "SELECT value, readings[1].lemma AS lemma, readings[1].tags AS tags, count(*) AS n, 1 AS most FROM tagged GROUP BY 1, 2, 3",
        "alternatives": _TAGGED + "SELECT readings[1].lemma AS lemma, readings[1].tags AS tags, (len(readings) - 1)::INT AS n_alts, count(*) AS n FROM tagged GROUP BY 1, 2, 3",
        "class_counts_by_document": _TAGGED + f"SELECT doc_id, count_if(readings[1].tags = 'unknown')::BIGINT AS unknown, count_if(readings[1].tags = 'unclass')::BIGINT AS unclass, count_if(readings[1].tags NOT IN ('unknown', 'unclass') AND {_CYRILLIC.format('value')})::BIGINT AS known FROM tagged GROUP BY doc_id",
        "semantic_tag_lookup": f"""WITH x AS (SELECT DISTINCT lemma, tags FROM lexicon_uk WHERE lemma IS NOT NULL AND tags IS NOT NULL),
            k(semtag, cond) AS (VALUES ('1:conc:hum', ''), ('2:abst', ''), ('3:conc:animal', ''), ('4:quantif', ''), ('5:case', ':v_rod'))
            SELECT lemma, tags, string_agg(semtag, ';' ORDER BY semtag) AS semtags FROM x, k WHERE (cond = '' OR contains(tags, cond)) AND NOT starts_with(string_split(tags, ':')[1], 'advp') AND ({_ALLOWED}) GROUP BY 1, 2""",
        "stress_tokens": _STRESSED + "SELECT value, stressed FROM stressed",
        "stress_summary": _STRESSED + f"SELECT count_if(length(regexp_replace(value, '[^{_VOW}]', '', 'g')) > 1 AND NOT contains(stressed, chr(769)))::BIGINT AS unknown, count_if(contains(stressed, '/') AND contains(stressed, chr(769)))::BIGINT AS homonyms FROM stressed",
        "ranking_summary": _TAGGED
        + _STATS
        + f""", many AS (SELECT lower(value) AS word FROM tagged WHERE len(readings) > 1), w AS (SELECT DISTINCT word FROM word_stats), e AS (SELECT DISTINCT {_ending('word', 't')} AS suffix FROM (SELECT word, {_RATE.format('postag')} AS t FROM word_stats)),
            j AS (SELECT w.word IS NOT NULL AS in_words, e.suffix IS NOT NULL AS in_ends FROM many LEFT JOIN w ON w.word = many.word LEFT JOIN e ON e.suffix = right(many.word, 3))
            SELECT count(*) AS total, count_if(in_words)::BIGINT AS word, count_if(NOT in_words)::BIGINT AS no_word, count_if(NOT in_words AND in_ends)::BIGINT AS word_end FROM j""",
        "clean_summary": f"""WITH a AS (SELECT request_id, text AS b, regexp_replace({_LONE}, '\\x{{2028}}\\n?', chr(10), 'g') AS a FROM clean_requests WHERE text IS NOT NULL)
            SELECT request_id, (len(regexp_extract_all(b, '{_U}[a-zA-Z]|[a-zA-Z]{_U}')) - len(regexp_extract_all(a, '{_U}[a-zA-Z]|[a-zA-Z]{_U}')))::INT AS mixes_fixed, (len(regexp_extract_all(b, '{_U}[-–‑¬][ \\t]*\\n')) - len(regexp_extract_all(a, '{_U}[-–‑¬][ \\t]*\\n')))::INT AS wraps_fixed FROM a""",
        "paradigm_shares": _TAGGED + _STATS + ", x AS (SELECT lemma, 'xp' || (length(word) % 3 + 1) AS xp, sum(rate) AS rate FROM word_stats GROUP BY 1, 2) SELECT lemma, xp, round(rate / sum(rate) OVER (PARTITION BY lemma), 6) AS share FROM x",
        "not_excluded": """WITH r AS (SELECT request_id, file_path AS path, list_last(string_split(file_path, '/')) AS name FROM clean_requests WHERE file_path IS NOT NULL), o AS (SELECT name FROM r GROUP BY name HAVING count(*) > 1 OR length(name) % 2 = 0)
            SELECT request_id, path FROM r WHERE name NOT IN (SELECT name FROM o)""",
        "report_file": _TAGGED + "SELECT value, count(*) AS n FROM tagged WHERE readings[1].tags = 'unclass' GROUP BY value",
        **dict.fromkeys(("text_files", "decoded_files", "listed_files"), _FILES),
        "statistics_file": _TAGGED + _STATS + "SELECT DISTINCT word, lemma, postag, round(rate, 9) AS rate, -1 AS offset, '__BEG' AS ctx_word, '' AS ctx_lemma, length(word)::DOUBLE AS cnt FROM word_stats WHERE NOT contains(word, ' ') AND NOT contains(lemma, ' ') AND NOT starts_with(word, '#')".replace("AS offset", 'AS "offset"'),
        "context_stats": _TAGGED
        + f""", o AS (SELECT {_KEYS}, tok_id, value, CASE WHEN len(readings) = 1 THEN {{'word': lower({_known('coalesce(clean, value)')}), 'lemma': readings[1].lemma, 'tags': readings[1].tags}} END AS t FROM tagged),
            n AS (SELECT t, lag(t) OVER w AS p, lead(t) OVER w AS q FROM o WINDOW w AS (PARTITION BY {_KEYS} ORDER BY tok_id, value)),
            c AS (SELECT t, -1 AS off_, p AS c FROM n UNION ALL SELECT t, 1, q FROM n)
            SELECT t.word AS word, t.lemma AS lemma, t.tags AS postag, off_ AS "offset", c.word AS ctx_word, c.lemma AS ctx_lemma, regexp_replace(c.tags, ':(arch|coll|slang|bad|vulg|up[0-9]{{2}}|ns)', '', 'g') AS ctx_postag, count(*)::DOUBLE AS cnt FROM c WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY ALL""",
    }

