"""The queries of ``marginalia.queries`` in SQL for DuckDB, built from common table expressions.

Nothing here comes from the code that the queries run: patterns, letters and word lists
are written down once more, so that a wrong one shows.
"""

from __future__ import annotations

from types import SimpleNamespace

SQL: dict[str, str] = {}

#: Fixed values, as text for RE2.
ROMAN = "(?i)^[ivxlcdm]+(primo|secundo|tercio|quarto|quinto|sexto|septimo|octauo|nono)?$"
PATRONYMIC = "(son|sson|sons|ssons|dotter|dottir|dottor|dottær|dottærs)$"
PATRONYMIC_VOTING = "(?i)(son|sson|sons|ssons|dotter|dottär|dottir|dottor|dottær|dottærs)$"
MIDDLE_DOT = "\u2027"
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"
ODD_SPACES = "\u2006\u2007\u2008\u2009\u200a\u00a0"
QUOTES = "\"\u201c\u201d\u201e\u00ab\u00bb'\u2018\u2019"
VOWELS = "aeiouyåäöæøẏ"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PIECE = rf"[{WS}]*(?:[\p{{L}}\p{{N}}_\x{{300}}-\x{{36f}}]+|[^\p{{L}}\p{{N}}_\x{{300}}-\x{{36f}}{WS}])"
#: Word lists of the queries.
FRACTION_LEXICON = ["the", "of", "and", "de", "la", "en", "der", "die", "que", "le"]
LEX = SimpleNamespace(
    stop_first=["the", "that", "with"], stop_second=["und", "der", "die"], cap_first=["The", "And"], cap_second=["La", "De"], locatives=["in", "de", "of", "en"],
    titles=["the", "la", "der", "el"], admin_suffixes=["of", "de", "und"], title_words=["the", "that", "la"], place_prefixes=["de", "en", "in"],
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sub(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def chain(x: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def within(x: str, words: list[str]) -> str:
    return f"coalesce({x} IN ({', '.join(map(q, words))}), false)"


CLEAN = strip(sub("translate(text, 'º°', '  ')", "  +", " "))
ODD = [(c, "") for c in INVISIBLE] + [(c, " ") for c in ODD_SPACES]


def html_clean(x: str) -> str:
    x = chain(sub(x, "<[^>]+>", " "), *ENTITIES)
    return strip(sub(chain(x, *[(c, "") for c in QUOTES]), f"[{WS}]+", " "))


def transcription(x: str) -> str:
    x = sub(x, r'(?s)<span class="hidden"[^>]*>.*?</span></span>')
    x = sub(x, r'<sup[^>]*class="note"[^>]*>[^<]*</sup>|<sup[^>]*data-target="#not-[^"]*"[^>]*>[^<]*</sup>')
    x = f"replace(replace(replace({x}, chr(13), ' '), chr(10), ' '), '<p>', chr(10) || chr(10))"
    x = sub(chain(sub(x, "<[^>]+>"), (" *) ", " ")), r"\([^)]*\)")
    return strip(sub(chain(x, ("[", ""), ("]", ""), *ENTITIES[:3], *ODD), " +", " "))


def corpus_clean(x: str) -> str:
    x = chain(sub(x, r"\([^)]*\)"), ("[", ""), ("]", ""), ("º", " "), ("°", " "), *ODD)
    return strip(sub(sub(x, r"[\x{e000}-\x{f8ff}]"), f"[{WS}]+", " "))


def between(x: str, start: str, end: str) -> str:
    after = f"CASE WHEN strpos({x}, {q(start)}) > 0 THEN substring({x}, strpos({x}, {q(start)}) + {len(start)}) END"
    return f"coalesce(CASE WHEN strpos({after}, {q(end)}) > 0 THEN {strip(f'substring({after}, 1, strpos({after}, {q(end)}) - 1)')} END, '')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w: w <> '')"


def fraction(x: str) -> str:
    ws = words(f"lower({x})")
    return f"CASE WHEN len({ws}) = 0 THEN 1.0 ELSE len(list_filter({ws}, lambda w: {within(sub('w', '[.,;:]+$'), FRACTION_LEXICON)}))::DOUBLE / len({ws}) END"


def lcs(a: str, b: str, kind: str = "BIGINT") -> str:
    """Length of the longest common subsequence; a is the shorter."""
    full = f"((1::{kind} << length({a})) - 1)"
    mask = f"list_sum(list_transform(generate_series(0, length({a}) - 1), lambda k: CASE WHEN substring({a}, (k + 1)::INTEGER, 1) = c THEN (1::{kind} << k::{kind}) ELSE 0::{kind} END))::{kind}"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask})), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def ratio(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    s, g = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    return f"CASE WHEN {total} = 0 THEN 100.0 WHEN least(length({a}), length({b})) = 0 THEN 0.0 WHEN length({s}) <= 62 THEN 200.0 * {lcs(s, g)} / {total} ELSE 200.0 * {lcs(s, g, 'HUGEINT')} / {total} END"


def pieces_of(name: str, source: str, key: str, expr: str) -> str:
    return f"""{name} AS (SELECT {key}, idx::INTEGER AS idx, piece, regexp_replace(piece, '^[{WS}]+', '') AS text FROM (
  SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS idx FROM (SELECT {key}, regexp_extract_all({expr}, {q(PIECE)}) AS p FROM {source})))"""


TOK = pieces_of("pc", "documents", "doc_id", CLEAN) + r""",
tok AS (SELECT doc_id, idx, text, regexp_matches(text, '^[\p{L}\p{N}_]') AS is_word FROM pc)"""
NB = """sc AS (SELECT *, sum(CASE WHEN text IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS stops FROM tok),
nb0 AS (SELECT doc_id, idx, text, stops, lag(text) OVER w AS prev_word, lead(text) OVER w AS next_word, lag(stops) OVER w AS bef FROM sc WHERE is_word WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
nb AS (SELECT *, prev_word IS NULL OR stops > bef AS sentence_initial FROM nb0)"""
CAPITAL = r"regexp_matches(text, '^\p{Lu}')"
CAP = f"""cap0 AS (SELECT doc_id, idx, text, prev_word, next_word, CASE WHEN NOT {CAPITAL} THEN NULL WHEN regexp_matches(text, {q(ROMAN)}) THEN 'roman_numeral' WHEN sentence_initial THEN 'sentence_initial'
  WHEN {within('text', LEX.cap_first)} THEN 'stop_first' WHEN {within('text', LEX.cap_second)} THEN 'stop_second' ELSE 'candidate' END AS status FROM nb),
cap AS (SELECT doc_id, idx, text, status, CASE WHEN status = 'candidate' THEN CASE WHEN {within('lower(prev_word)', LEX.locatives)} THEN 'Location'
  WHEN regexp_matches(lower(text), {q(PATRONYMIC)}) OR coalesce(regexp_matches(lower(next_word), {q(PATRONYMIC)}), false) OR {within('lower(prev_word)', LEX.titles)} THEN 'Person'
  WHEN {within('lower(next_word)', LEX.admin_suffixes)} THEN 'Location' ELSE 'Unknown' END END AS label FROM cap0)"""


def names_of(name: str, table: str) -> str:
    return pieces_of(f"{name}0", table, "1 AS one", "text").replace("1 AS one, idx::", "one, idx::").replace("SELECT 1 AS one, unnest", "SELECT one, unnest") + f""",
{name} AS (SELECT lower(text) AS name_lower, min(text) AS source_form FROM {name}0 WHERE {CAPITAL} AND length(text) >= 4 GROUP BY 1)"""


NAMES = names_of("plc", "benchmark") + ",\n" + names_of("per", "conversations")
STOP = f"CASE WHEN {within('lower(text)', LEX.stop_first)} THEN 'first' WHEN {within('lower(text)', LEX.stop_second)} THEN 'second' WHEN regexp_matches(text, {q(ROMAN)}) THEN 'roman_numeral' END"


def exact_signal(name: str = "s2", places: str = "plc", persons: str = "per") -> str:
    return f"""{name} AS (SELECT doc_id, idx, text, label, CASE label WHEN 'Location' THEN 'places' WHEN 'Person' THEN 'persons' END AS source, label IS NOT NULL AND l AND p AS conflict, l, p, stop FROM (
  SELECT t.doc_id, t.idx, t.text, a.name_lower IS NOT NULL AS l, b.name_lower IS NOT NULL AS p, {STOP} AS stop, CASE WHEN ({STOP}) IS NOT NULL THEN NULL WHEN a.name_lower IS NOT NULL THEN 'Location' WHEN b.name_lower IS NOT NULL THEN 'Person' END AS label
  FROM tok t LEFT JOIN {places} a ON lower(t.text) = a.name_lower LEFT JOIN {persons} b ON lower(t.text) = b.name_lower WHERE t.is_word))"""


def vote(name: str, capitals: bool = True, names: str = "s2", entities: str = "") -> str:
    s1 = f"LEFT JOIN (SELECT doc_id, idx, label AS l1 FROM {entities}) USING (doc_id, idx)" if entities else ""
    s2 = f"LEFT JOIN (SELECT doc_id, idx, label AS l2 FROM {names} WHERE label IS NOT NULL) USING (doc_id, idx)" if names else ""
    s3 = "LEFT JOIN (SELECT doc_id, idx, label AS l3 FROM cap WHERE label IS NOT NULL) USING (doc_id, idx)" if capitals else ""
    l1, l2, l3 = ("l1" if entities else "NULL::VARCHAR"), ("l2" if names else "NULL::VARCHAR"), ("l3" if capitals else "NULL::VARCHAR")
    n = name
    return f"""{n}a AS (SELECT tok.*, {l1} AS s1, {l2} AS s2, {l3} AS s3 FROM tok {s1} {s2} {s3}),
{n}b AS (SELECT *, CASE WHEN is_word THEN coalesce(CASE WHEN s1 IN ('Person', 'Location') THEN s1 END, CASE WHEN s2 <> 'Unknown' THEN s2 END, CASE WHEN s3 <> 'Unknown' THEN s3 END) END AS ty FROM {n}a),
{n}c AS (SELECT *, CASE WHEN NOT is_word THEN 'not_word' WHEN s1 IS NULL AND s2 IS NULL AND s3 IS NULL THEN CASE WHEN regexp_matches(text, {q(PATRONYMIC_VOTING)}) THEN 'patronymic' ELSE 'no_signal' END WHEN ty IS NULL THEN 'unknown'
  WHEN ty = 'Person' AND {within('lower(text)', LEX.title_words)} THEN 'title' WHEN ty = 'Location' AND {within('lower(text)', LEX.place_prefixes)} THEN 'prefix' ELSE 'entity' END AS c FROM {n}b),
{n}d AS (SELECT *, CASE WHEN c IN ('patronymic', 'title') THEN 'Person' WHEN c = 'prefix' THEN 'Location' END AS keeps FROM {n}c),
{n}e AS (SELECT *, sum((keeps IS NULL)::INTEGER) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM {n}d),
{n}f AS (SELECT *, max(CASE WHEN c = 'entity' THEN ty END) OVER (PARTITION BY doc_id, island) AS given FROM {n}e),
{n}g AS (SELECT *, CASE WHEN sum((keeps IS NOT NULL AND keeps IS DISTINCT FROM given)::INTEGER) OVER (PARTITION BY doc_id, island ORDER BY idx) = 0 THEN given END AS state FROM {n}f),
{n}h AS (SELECT *, lag(state) OVER (PARTITION BY doc_id ORDER BY idx) AS bef FROM {n}g),
{n} AS (SELECT doc_id, idx, text, is_word, CASE WHEN state IS NULL THEN 'O' WHEN bef = state THEN 'I-' || state ELSE 'B-' || state END AS label,
  CASE WHEN c = 'not_word' THEN 'not_word' WHEN c = 'patronymic' THEN CASE WHEN state IS NULL THEN 'no_signal' ELSE 'patronymic_continuation' END WHEN c = 'no_signal' THEN 'no_signal' WHEN c = 'unknown' THEN 'only_capitalisation_unknown_type'
    WHEN state IS NOT NULL THEN 'voted_entity' WHEN c = 'title' THEN 'title_stripped' ELSE 'location_prefix_stripped' END AS reason,
  CASE WHEN is_word THEN concat_ws('+', CASE WHEN s1 IS NOT NULL THEN 'signal_1' END, CASE WHEN s2 IS NOT NULL THEN 'signal_2' END, CASE WHEN s3 IS NOT NULL THEN 'signal_3' END) ELSE '' END AS signals,
  CASE WHEN is_word THEN CASE WHEN s1 IN ('Person', 'Location') THEN 'signal_1' WHEN s2 IN ('Person', 'Location') THEN 'signal_2' WHEN s3 IN ('Person', 'Location') THEN 'signal_3' END END AS type_source,
  is_word AND len(list_distinct(list_filter([s1, s2, s3], lambda x: x IN ('Person', 'Location')))) > 1 AS type_disagreement FROM {n}h)"""


BASE = f"{TOK},\n{NB},\n{CAP},\n{NAMES},\n{exact_signal()}"
V = f"{BASE},\n{vote('v')}"
GP = f"{V}, per_lo AS (SELECT * FROM per WHERE name_lower < 'm'),\n{exact_signal('s2p', 'per_lo', 'plc')},\n{vote('vp', names='s2p')}"


def spans(name: str, rows: str, how: str, keys: str = "doc_id") -> str:
    """how: io, bio, lenient or sentence."""
    io = "regexp_replace(label, '^[BI]-', '')"
    w = f"(PARTITION BY {keys} ORDER BY idx)"
    last = f"SELECT {keys}, min_by(ty, idx) AS type, min(idx) AS start_idx, max(idx) AS end_idx, string_agg(text, ' ' ORDER BY idx) AS text, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS places FROM"
    if how in ("io", "lenient"):
        opens = f"({io} IS DISTINCT FROM lag({io}) OVER {w})" if how == "io" else f"({io} <> 'O' AND (label LIKE 'B-%' OR {io} IS DISTINCT FROM lag({io}) OVER {w}))"
        return f"""{name}x AS (SELECT *, {io} AS ty, {opens} AS o FROM {rows}), {name}y AS (SELECT *, sum(o::INTEGER) OVER {w} AS run FROM {name}x),
{name} AS ({last} {name}y WHERE ty <> 'O' GROUP BY {keys}, run)"""
    where = "WHERE is_word" if how == "bio" else ""
    return f"""{name}x AS (SELECT *, {io} AS ty, (label LIKE 'B-%' OR label = 'O') AS o FROM {rows} {where}), {name}y AS (SELECT *, sum(o::INTEGER) OVER {w} AS run FROM {name}x),
{name}z AS (SELECT *, first_value(label) OVER (PARTITION BY {keys}, run ORDER BY idx) AS head FROM {name}y), {name} AS ({last} {name}z WHERE head LIKE 'B-%' GROUP BY {keys}, run)"""


def add(name: str, select: str, ctes: str = "", recursive: bool = False) -> None:
    SQL[name] = (f"WITH {'RECURSIVE ' * recursive}{ctes}\n" if ctes else "") + select


# text
add("clean_text", f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
add("tokenize", "SELECT doc_id, idx, text, is_word FROM tok", TOK)
add("token_offsets", """SELECT doc_id, idx, text, (e - length(text))::INTEGER AS start_at, e::INTEGER AS end_at, is_word FROM (
  SELECT doc_id, idx, pc.text, is_word, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM pc JOIN tok USING (doc_id, idx))""", TOK)
SKELETON = lambda x: sub(f"lower({x})", rf"[^\p{{L}}]|[{VOWELS}]")
add("consonant_skeleton", f"SELECT DISTINCT text, {SKELETON('text')} AS skeleton FROM tok WHERE is_word", TOK)
add("html_clean", f"SELECT page_id, {html_clean('html')} AS cleaned FROM pages")
add("transcription_clean", f"SELECT page_id, {transcription('html')} AS cleaned FROM pages")
add("corpus_clean", f"SELECT doc_id, {corpus_clean('text')} AS cleaned FROM documents")
add("extract_between", f"SELECT page_id, {between('html', '<title>', '</title>')} AS title FROM pages")
DATED = html_clean(f"regexp_replace({sub(between('html', '<footer>', '</footer>'), '<a .*</a>')}, '^[^\\n]*?>', '')")
add("page_fields", f"""SELECT page_id, {html_clean(between('html', '<title>', '</title>'))} AS summary, {transcription(between('html', '<article>', '</article>'))} AS edition,
  {DATED} AS dated, {html_clean(between('html', '<nav>', '</nav>'))} AS place, {html_clean(between('html', 'lang="', '"'))} AS language FROM pages""")
add("lexicon_fraction", f"SELECT doc_id, round({fraction('text')}, 6) AS fraction FROM documents")
add("edition_texts", f"SELECT doc_id, replace(t, '{MIDDLE_DOT}', '') AS text FROM (SELECT doc_id, {strip('''coalesce(text, '')''')} AS t FROM documents) WHERE t <> ''")
RAWLABEL = "CASE event_id % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Location' WHEN 2 THEN 'Organization' ELSE 'MISC' END"
add("ner_label_map", f"SELECT event_id, {RAWLABEL} AS mapped_label, CASE event_id % 4 WHEN 2 THEN 'org' WHEN 3 THEN 'misc' ELSE 'entities' END AS bucket, round(value, 4) AS score FROM events")
add("safe_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages")
add("perplexity", "SELECT event_id, CASE WHEN value < 100 THEN format('{:.6e}', exp(value)) ELSE 'inf' END AS ppl FROM events")
add("token_resplit", f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY old, idx) - 1)::INTEGER AS idx, text, CASE WHEN old % 7 = 0 THEN 'B-Person' ELSE 'O' END AS label FROM rs""",
    TOK + ",\nsrc AS (SELECT doc_id, idx AS old, CASE WHEN idx % 7 = 0 THEN text || 'º' || text ELSE text END AS text FROM tok),\n" + pieces_of("rs", "src", "doc_id, old", "translate(text, 'º°', '  ')"))
add("detokenize", "SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS text FROM tok GROUP BY doc_id", TOK)
# windows and predicates
add("neighbour_words", "SELECT doc_id, idx, text, prev_word, next_word FROM nb", f"{TOK}, {NB}")
add("sentence_initial", "SELECT doc_id, idx, sentence_initial FROM nb", f"{TOK}, {NB}")
add("word_ngrams", """SELECT ngram, span_len, count(*) AS n FROM (
  SELECT text AS ngram, 1 AS span_len FROM w UNION ALL SELECT text || ' ' || b, 2 FROM w WHERE b IS NOT NULL UNION ALL SELECT text || ' ' || b || ' ' || c, 3 FROM w WHERE c IS NOT NULL) GROUP BY ALL""",
    f"{TOK}, w AS (SELECT text, lead(text) OVER o AS b, lead(text, 2) OVER o AS c FROM tok WHERE is_word WINDOW o AS (PARTITION BY doc_id ORDER BY idx))")
PLACES = "w AS (SELECT doc_id, idx, text, lead(text) OVER o AS b, lead(text, 2) OVER o AS c, lead(idx) OVER o AS ib, lead(idx, 2) OVER o AS ic FROM tok WHERE is_word WINDOW o AS (PARTITION BY doc_id ORDER BY idx))"
add("word_ngrams_by_document", """SELECT doc_id, ngram, span_len, count(*) AS n, md5(string_agg(p, ',' ORDER BY idx)) AS places FROM (SELECT doc_id, idx, text AS ngram, 1 AS span_len, idx::VARCHAR AS p FROM w
  UNION ALL SELECT doc_id, idx, text || ' ' || b, 2, idx || '-' || ib FROM w WHERE b IS NOT NULL UNION ALL SELECT doc_id, idx, text || ' ' || b || ' ' || c, 3, idx || '-' || ib || '-' || ic FROM w WHERE c IS NOT NULL) GROUP BY ALL""", f"{TOK}, {PLACES}")
add("roman_numerals", f"SELECT text, count(*) AS n FROM tok WHERE is_word AND regexp_matches(text, {q(ROMAN)}) GROUP BY text", TOK)
add("patronymic", f"SELECT * FROM (SELECT DISTINCT text, regexp_matches(lower(text), {q(PATRONYMIC)}) AS strict, regexp_matches(text, {q(PATRONYMIC_VOTING)}) AS voting FROM tok WHERE is_word) WHERE strict OR voting", TOK)
add("cap_candidates", "SELECT doc_id, idx, text, status, label FROM cap WHERE status IS NOT NULL", f"{TOK}, {NB}, {CAP}")
add("cap_summary", """SELECT count(*) FILTER (status = 'candidate') AS candidates, count(*) FILTER (status IN ('stop_first', 'stop_second')) AS stoplisted, count(*) FILTER (status = 'roman_numeral') AS roman_numerals,
  count(*) FILTER (status = 'sentence_initial') AS sentence_initial, count(*) FILTER (label IN ('Person', 'Location')) AS typed, count(*) FILTER (label = 'Unknown') AS untyped,
  count(*) FILTER (label = 'Person') AS person, count(*) FILTER (label = 'Location') AS location FROM cap""", f"{TOK}, {NB}, {CAP}")
add("stoplist_reason", f"SELECT {STOP} AS reason, count(*) AS n FROM tok WHERE is_word GROUP BY 1", TOK)
# name lists
FIT = r"regexp_matches(w, '[a-zA-ZåäöæøþðẏÅÄÖÆØ]') AND NOT regexp_matches(w, '^[(\[]|^\.\.\.') AND NOT regexp_matches(w, '^[\p{Nd}–:°.-]+$') AND length(regexp_replace(w, '[^a-zA-ZåäöæøþðẏÅÄÖÆØ]', '', 'g')) >= 3"
add("gazetteer_places", "SELECT name_lower, coalesce(arg_max(entry, line_no) FILTER (n = 1), arg_min(entry, line_no * 100 + pos) FILTER (n > 1)) AS source_form FROM ok GROUP BY name_lower", f"""
bw AS (SELECT item_id, unnest(s) AS w, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT item_id, string_split(text, ' ') AS s FROM benchmark)),
ln AS (SELECT item_id * 1000 + pos AS line_no, {strip("CASE WHEN pos % 3 = 0 THEN w || ' ' || lower(w) || 'a' ELSE w END")} AS entry FROM bw),
en AS (SELECT line_no, entry, {words('entry')} AS ws FROM ln WHERE line_no >= 32 AND entry <> '' AND strpos(lower(entry), 'qu') = 0),
wd AS (SELECT line_no, entry, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM en),
ok AS (SELECT *, lower(w) AS name_lower FROM wd WHERE {FIT} AND (n = 1 OR (n <= 4 AND length(w) > 2 AND lower(w) NOT IN ('the', 'and'))))""")
add("gazetteer_place_statistics", """SELECT count(*) AS raw, count(*) FILTER (strpos(lower(entry), 'qu') = 0) AS kept, count(*) FILTER (strpos(lower(entry), 'qu') > 0) AS filtered_out, (SELECT count(DISTINCT name_lower) FROM ok) AS unique_names
  FROM ln WHERE line_no >= 32 AND entry <> ''""", SQL["gazetteer_places"].split("SELECT name_lower, coalesce")[0].removeprefix("WITH ").strip())
add("gazetteer_simple", "SELECT lower(e) AS name_lower, arg_min(e, (item_id, pos)) AS source_form FROM l WHERE length(e) > 1 GROUP BY 1", f"l AS (SELECT item_id, pos, {strip('part')} AS e FROM (SELECT item_id, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM (SELECT item_id, string_split(text, '.') AS p FROM benchmark)))")
PERSON = strip(sub(sub(sub(chain(strip("raw"), *[(c, "") for c in '±?()[]"']), "^[* ]+"), r"^\.\.\."), " +", " "))
VARIANTS = f"""cells AS (SELECT conv_id * 1000 + turn AS row_no, unnest([0, 1]) AS field, unnest([role, text]) AS cell FROM conversations),
vs AS (SELECT row_no, field, unnest(s) AS raw, generate_subscripts(s, 1) AS variant FROM (SELECT row_no, field, string_split(cell, ',') AS s FROM cells)),
vn AS (SELECT row_no, field, variant, {PERSON} AS name FROM vs)"""
add("gazetteer_persons", "SELECT lower(name) AS name_lower, arg_min(name, (row_no, field, variant)) AS source_form FROM vn WHERE length(name) > 1 AND name NOT LIKE '%-' GROUP BY 1", VARIANTS)
add("gazetteer_statistics", """SELECT count(*) AS raw, count(*) FILTER (name = '') AS empty, count(*) FILTER (length(name) = 1) AS short, count(*) FILTER (length(name) > 1 AND name LIKE '%-') AS cut_off,
  count(DISTINCT CASE WHEN length(name) > 1 AND name NOT LIKE '%-' THEN lower(name) END) AS unique_names FROM vn""", VARIANTS)
add("gazetteer_merge", "SELECT name_lower, coalesce(a.source_form, b.source_form) AS source_form, a.name_lower IS NULL AS is_new FROM plc a FULL JOIN per b USING (name_lower)", NAMES)
add("gazetteer_exact", "SELECT DISTINCT lower(text) AS word_lower FROM tok WHERE is_word AND lower(text) IN (SELECT name_lower FROM plc)", f"{TOK}, {NAMES}")


def letters(x: str) -> str:
    return f"list_reduce(list_transform(list_distinct(string_split({x}, '')), lambda c: 1::BIGINT << (unicode(c) % 61)), lambda m, n: m | n)"


def similar(name: str, source: str, listed: str) -> str:
    """Pairs whose letters differ too much can't reach 80: each bit that only one side has is a character that only one side has."""
    return f"""{name}w AS MATERIALIZED (SELECT word_lower, {letters('word_lower')} AS wm, length(word_lower) AS wl FROM {source}), {name}n AS MATERIALIZED (SELECT name_lower, {letters('name_lower')} AS nm, length(name_lower) AS nl FROM {listed}),
{name} AS MATERIALIZED (SELECT word_lower, arg_min(name_lower, (-score, name_lower)) AS name_lower, max(score) AS score FROM (
  SELECT word_lower, name_lower, {ratio('word_lower', 'name_lower')} AS score FROM {name}w, {name}n WHERE wl * 2 <= nl * 3 AND nl * 2 <= wl * 3 AND bit_count(xor(wm, nm)) <= 0.2 * (wl + nl) + 1e-9
  ) WHERE score >= 80 GROUP BY word_lower)"""


CAPWORDS = f"cw AS (SELECT DISTINCT lower(text) AS word_lower FROM tok WHERE is_word AND {CAPITAL} AND length(text) >= 4)"
add("gazetteer_fuzzy_best", "SELECT word_lower, name_lower, round(score, 6) AS score FROM best", f"{TOK}, {NAMES}, {CAPWORDS}, {similar('best', 'cw', 'plc')}")
add("gazetteer_signal", "SELECT doc_id, idx, text, label, source, 'exact' AS level, conflict FROM s2 WHERE label IS NOT NULL", f"""{TOK}, {NAMES},
per2 AS (SELECT name_lower FROM per WHERE name_lower NOT IN (SELECT name_lower FROM plc) UNION ALL SELECT name_lower FROM plc WHERE name_lower < 'f'), {exact_signal(persons='per2')}""")
BLOCKED = within("name_lower", [*LEX.stop_first, *LEX.stop_second])
HITS = lambda n, listed: f"""{n}r AS (SELECT word_lower FROM cw WHERE word_lower NOT IN (SELECT name_lower FROM {listed})), {similar(n + 'b', n + 'r', listed)},
{n} AS (SELECT name_lower AS word_lower, 100.0 AS score, 'exact' AS level, name_lower AS name FROM {listed}
  UNION ALL SELECT word_lower, score, 'fuzzy', name_lower FROM {n}b WHERE least(length(word_lower), length(name_lower))::DOUBLE / greatest(length(word_lower), length(name_lower)) >= 0.7 AND NOT {BLOCKED})"""  # noqa: E731
add("gazetteer_signal_fuzzy", """SELECT text, label, CASE label WHEN 'Location' THEN 'places' ELSE 'persons' END AS source, CASE WHEN ll = 'exact' OR pl = 'exact' THEN 'exact' ELSE 'fuzzy' END AS level,
  CASE label WHEN 'Location' THEN ln ELSE pn END AS name, count(*) AS n, round(max(greatest(ls, ps)), 6) AS score FROM sig GROUP BY ALL""", f"""{TOK}, {NAMES}, {CAPWORDS}, plo AS (SELECT * FROM plc WHERE name_lower < 'o'), {HITS('hl', 'plc')}, {HITS('hp', 'plo')},
sg0 AS (SELECT t.text, {STOP} AS stop, CASE WHEN a.level = 'exact' OR ({CAPITAL} AND length(t.text) >= 4) THEN a.score END AS ls, CASE WHEN a.level = 'exact' OR ({CAPITAL} AND length(t.text) >= 4) THEN a.level END AS ll, a.name AS ln,
  CASE WHEN b.level = 'exact' OR ({CAPITAL} AND length(t.text) >= 4) THEN b.score END AS ps, CASE WHEN b.level = 'exact' OR ({CAPITAL} AND length(t.text) >= 4) THEN b.level END AS pl, b.name AS pn
  FROM tok t LEFT JOIN hl a ON lower(t.text) = a.word_lower LEFT JOIN hp b ON lower(t.text) = b.word_lower WHERE t.is_word),
sig AS (SELECT *, CASE WHEN coalesce(ls, -1) >= coalesce(ps, -1) THEN 'Location' ELSE 'Person' END AS label FROM sg0 WHERE stop IS NULL AND (ls IS NOT NULL OR ps IS NOT NULL))""")
add("gazetteer_signal_summary", """SELECT count(label) AS matches, count(*) FILTER (stop IS NOT NULL AND (l OR p)) AS stoplisted, count(*) FILTER (source = 'places') AS places, count(*) FILTER (source = 'persons') AS persons,
  count(*) FILTER (conflict) AS conflicts, count(label) AS exact, 0::BIGINT AS fuzzy FROM s2""", f"{TOK}, {NAMES}, {exact_signal()}")
add("indel_ratio", f"SELECT name_lower, other, round({ratio('name_lower', 'other')}, 6) AS ratio FROM pairs WHERE other IS NOT NULL", f"{NAMES}, pairs AS (SELECT name_lower, lead(name_lower) OVER (PARTITION BY name_lower[1] ORDER BY name_lower) AS other FROM plc)")
# entities
ENT = pieces_of("ec", "conversations", "conv_id, turn", CLEAN) + r""",
ew AS (SELECT conv_id, turn, idx, text, lead(text) OVER (PARTITION BY conv_id, turn ORDER BY idx) AS nxt FROM ec WHERE regexp_matches(text, '^[\p{L}\p{N}_]')),
ent AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, idx) - 1)::INTEGER AS ord, text || ' ' || nxt AS entity FROM ew WHERE regexp_matches(text, '^\p{Lu}') AND regexp_matches(nxt, '^\p{Lu}'))"""
MATCH_REST = f"""{ENT},
ww AS (SELECT doc_id, idx, text AS a, lead(text) OVER o AS b, lead(text, 2) OVER o AS c, lead(idx) OVER o AS ib, lead(idx, 2) OVER o AS ic FROM tok WHERE is_word AND doc_id IN (SELECT doc_id FROM ent) WINDOW o AS (PARTITION BY doc_id ORDER BY idx)),
grams AS (SELECT doc_id, idx AS start_idx, 1 AS span_len, a AS ngram, [idx] AS locs FROM ww UNION ALL SELECT doc_id, idx, 2, a || ' ' || b, [idx, ib] FROM ww WHERE b IS NOT NULL UNION ALL SELECT doc_id, idx, 3, a || ' ' || b || ' ' || c, [idx, ib, ic] FROM ww WHERE c IS NOT NULL),
own AS (SELECT DISTINCT doc_id, entity, lower(entity) AS low, {SKELETON('entity')} AS skel FROM ent),
pr AS (SELECT grams.*, entity, low, skel, lower(ngram) AS sl, {SKELETON('ngram')} AS ss FROM grams JOIN own USING (doc_id)),
s2x AS (SELECT *, low = sl AS same, CASE WHEN low <> sl AND length(skel) >= 3 AND ss <> '' AND 200.0 * least(length(skel), length(ss)) >= 80 * (length(skel) + length(ss)) THEN {ratio('skel', 'ss')} END AS k2 FROM pr),
s3x AS (SELECT *, CASE WHEN NOT same AND NOT coalesce(k2 >= 80, false) AND 200.0 * least(length(low), length(sl)) >= 60 * (length(low) + length(sl)) THEN {ratio('low', 'sl')} END AS k3 FROM s2x),
lv AS (SELECT *, CASE WHEN same THEN 1 WHEN k2 >= 80 THEN 2 WHEN k3 >= 60 THEN 3 END AS level, CASE WHEN same THEN 100.0 WHEN k2 >= 80 THEN k2 ELSE k3 END AS score FROM s3x),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity ORDER BY level, (span_len <> 2)::INTEGER, score DESC, span_len, start_idx) AS rank FROM lv WHERE level IS NOT NULL)"""
MATCH = f"{TOK}, {MATCH_REST}"
add("entity_top_matches", """SELECT doc_id, entity, count(*) AS n_matches, md5(string_agg(rank || ':' || level || ':' || round(score * 1000000)::BIGINT || ':' || start_idx || ':' || span_len, ',' ORDER BY rank) FILTER (rank <= 10)) AS best FROM rk GROUP BY doc_id, entity""", MATCH)
add("entity_matches_kept", "SELECT doc_id, entity, len(kept) AS kept, list_min(kept) AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity ORDER BY step DESC) AS r FROM nms) WHERE r = 1", f"""{MATCH},
rl AS (SELECT doc_id, entity, list(rank ORDER BY rank) AS ranks, list(locs ORDER BY rank) AS places FROM rk GROUP BY doc_id, entity),
nms AS (SELECT doc_id, entity, 1 AS step, [ranks[1]] AS kept, places[1] AS used FROM rl
  UNION ALL SELECT n.doc_id, n.entity, n.step + 1, CASE WHEN list_has_any(n.used, l.places[n.step + 1]) THEN n.kept ELSE list_append(n.kept, l.ranks[n.step + 1]) END,
    CASE WHEN list_has_any(n.used, l.places[n.step + 1]) THEN n.used ELSE list_concat(n.used, l.places[n.step + 1]) END FROM nms n JOIN rl l USING (doc_id, entity) WHERE n.step < len(l.ranks))""", True)
add("entity_projection_best", "SELECT doc_id, entity, level, round(score, 6) AS score, span_len, start_idx, ngram FROM rk WHERE rank = 1", MATCH)
add("entity_first_writer", """SELECT doc_id, idx, CASE WHEN ord % 2 = 0 THEN 'Person' ELSE 'Location' END AS label, ord, CASE WHEN pos = 1 THEN 'B' ELSE 'I' END AS bio_position, level, round(score, 6) AS score FROM (
  SELECT doc_id, unnest(locs) AS idx, generate_subscripts(locs, 1) AS pos, ord, level, score FROM ent JOIN (SELECT * FROM rk WHERE rank = 1) USING (doc_id, entity)) QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY ord) = 1""", MATCH)
add("entity_unmatched", "SELECT doc_id, ord, entity AS text FROM ent WHERE (doc_id, entity) NOT IN (SELECT (doc_id, entity) FROM rk)", MATCH)
# voting and spans
add("vote_labels", "SELECT doc_id, idx, text, label FROM v", V)
add("vote_reasons", "SELECT reason, signals, type_source, type_disagreement, count(*) AS n FROM v GROUP BY ALL", V)
add("signal_combinations", "SELECT signals, count(*) AS n FROM v WHERE reason = 'voted_entity' GROUP BY 1", V)
add("vote_summary", """SELECT doc_id, count(*) AS total_tokens, count(*) FILTER (is_word) AS word_tokens, count(*) FILTER (label <> 'O') AS entity_tokens, count(*) FILTER (label LIKE '%Person') AS person_tokens,
  count(*) FILTER (label LIKE '%Location') AS location_tokens, count(*) FILTER (label = 'O') AS o_tokens, count(*) FILTER (type_disagreement AND reason = 'voted_entity') AS type_disagreements,
  count(*) FILTER (reason = 'only_capitalisation_unknown_type') AS cap_only_unknown FROM v GROUP BY doc_id""", V)
add("review_unknown_tokens", "SELECT doc_id, text, count(*) AS n, min(idx) AS first_idx FROM v WHERE reason = 'only_capitalisation_unknown_type' GROUP BY doc_id, text", V)
add("doc_summary", """SELECT doc_id, n_tokens, n_words, coalesce(n_person, 0) AS n_person, coalesce(n_location, 0) AS n_location FROM (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (is_word) AS n_words FROM v GROUP BY 1)
  LEFT JOIN (SELECT doc_id, count(*) FILTER (type = 'Person') AS n_person, count(*) FILTER (type = 'Location') AS n_location FROM bs GROUP BY 1) USING (doc_id)""", f"{V}, {spans('bs', 'v', 'bio')}")
for _name, _how in (("io_spans", "io"), ("bio_spans", "bio"), ("seqeval_spans", "lenient")):
    add(_name, "SELECT doc_id, type, start_idx, end_idx, text, places FROM sp", f"{V}, {spans('sp', 'v', _how)}")
add("io_to_bio", "SELECT doc_id, idx, text, io, CASE WHEN io = 'O' THEN 'O' WHEN lag(io) OVER (PARTITION BY doc_id ORDER BY idx) = io THEN 'I-' || io ELSE 'B-' || io END AS label FROM (SELECT *, regexp_replace(label, '^[BI]-', '') AS io FROM v)", V)
LINE = "text || ' ' || CASE WHEN is_word THEN label ELSE 'O' END || CASE WHEN NOT is_word AND text IN ('.', '!', '?') THEN chr(10) ELSE '' END"
add("conll_emit", f"SELECT doc_id, md5(t) AS digest, length(t)::INTEGER AS n_chars FROM (SELECT doc_id, string_agg({LINE}, chr(10) ORDER BY idx) || chr(10) AS t FROM v GROUP BY doc_id)", V)
STOPS = "sum((NOT is_word AND text IN ('.', '!', '?'))::INTEGER) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SENT = f"se AS (SELECT doc_id, idx, text, is_word, CASE WHEN is_word THEN label ELSE 'O' END AS label, coalesce({STOPS}, 0) AS sent FROM v)"
add("conll_read_sentences", f"""SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY sent) - 1)::INTEGER AS sent_id, (row_number() OVER (PARTITION BY doc_id, sent ORDER BY idx) - 1)::INTEGER AS pos, text, label FROM se WHERE text <> '{MIDDLE_DOT}'""", f"{V}, {SENT}")
add("conll_parse_entities", "SELECT doc_id, sent AS sent_id, type, start_idx, end_idx, text FROM sp", f"{V}, {SENT}, {spans('sp', 'se', 'sentence', 'doc_id, sent')}".replace("AS sent FROM v)", "::BIGINT AS sent FROM v)"))
# metrics
CMP = f"{GP}, {spans('gs', 'v', 'lenient')}, {spans('ps', 'vp', 'lenient')}, g AS (SELECT doc_id, type, start_idx, end_idx FROM gs), r AS (SELECT doc_id, type, start_idx, end_idx FROM ps)"
PRF = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1"
SCORES = f"""cm AS (SELECT coalesce(g.type, r.type) AS type, g.doc_id IS NOT NULL AS ing, r.doc_id IS NOT NULL AS inp FROM g FULL JOIN r ON g.doc_id = r.doc_id AND g.type = r.type AND g.start_idx = r.start_idx AND g.end_idx = r.end_idx),
sc0 AS (SELECT type, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM cm GROUP BY type), sco AS (SELECT type, tp, fp, fn, tp + fn AS support, {PRF} FROM sc0)"""
R3 = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
add("metrics_entity", f"SELECT type, tp, fp, fn, support, {R3} FROM sco", f"{CMP}, {SCORES}")
AVG = f"""tot AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(support)::BIGINT AS support FROM sco), avgs AS (
  SELECT 'micro' AS average, {PRF}, support FROM tot UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM sco
  UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM sco)"""
add("metrics_entity_avg", f"SELECT average, {R3}, support FROM avgs", f"{CMP}, {SCORES}, {AVG}")
PAIRS = f"{GP}, pairs AS (SELECT v.doc_id, v.idx, v.label AS gl, vp.label AS pl, regexp_replace(v.label, '^[BI]-', '') AS gold, regexp_replace(vp.label, '^[BI]-', '') AS pred FROM v JOIN vp USING (doc_id, idx)), conf AS (SELECT gold, pred, count(*) AS n FROM pairs GROUP BY 1, 2)"
add("token_confusion", "SELECT gold, pred, n FROM conf", PAIRS)
TOKSCORE = f"""kinds AS (SELECT unnest(['Person', 'Location']) AS type), sc1 AS (SELECT type, coalesce(sum(n) FILTER (gold = type AND pred = type), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (gold <> type AND pred = type), 0)::BIGINT AS fp,
  coalesce(sum(n) FILTER (gold = type AND pred <> type), 0)::BIGINT AS fn FROM conf, kinds GROUP BY type), sco AS (SELECT type, tp, fp, fn, tp + fn AS support, {PRF} FROM sc1)"""
add("metrics_token", f"SELECT type, tp, fp, fn, support, {R3}, (SELECT round(sum(n) FILTER (gold = pred)::DOUBLE / sum(n), 6) FROM conf) AS accuracy FROM sco", f"{PAIRS}, {TOKSCORE}")
add("metrics_token_avg", f"SELECT average, {R3}, support FROM avgs", f"{PAIRS}, {TOKSCORE}, {AVG}")
add("class_accuracy", """SELECT gold, round(coalesce(sum(n) FILTER (gold = pred), 0)::DOUBLE / sum(n), 6) AS accuracy, sum(n)::BIGINT AS support, round((SELECT sum(n) FILTER (pred = 'O')::DOUBLE / sum(n) FROM conf), 6) AS pred_o_share,
  (SELECT sum(n) FILTER (pred = 'O')::DOUBLE / sum(n) FROM conf) > 0.95 AS mostly_o FROM conf GROUP BY gold""", PAIRS)
add("class_distribution", "SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY label", V)
add("doc_eval_stats", "SELECT doc_id, count(*) AS tokens, count(*) FILTER (gl LIKE 'B-%') AS gold_entities, count(*) FILTER (pl LIKE 'B-%') AS pred_entities, round(avg((gl <> 'O')::INTEGER), 6) AS entity_share FROM pairs GROUP BY doc_id", PAIRS)
add("alignment_check", "SELECT doc_id, count(*) AS n FROM tok WHERE doc_id % 10 = 3 AND idx % 5 = 0 GROUP BY doc_id", TOK)
COD = "cod AS (SELECT doc_id AS item_id, unnest(['quality', 'toxic']) AS coder, unnest([quality, toxic])::VARCHAR AS label FROM labels)"
add("krippendorff_alpha", """SELECT round(CASE WHEN d_e = 0 THEN 1.0 ELSE 1 - d_o / d_e END, 6) AS alpha, n_units, n_all::BIGINT AS n_values FROM (
  SELECT d_o, n_units, n_all, (n_all * n_all - sq)::DOUBLE / greatest(n_all - 1, 1) AS d_e FROM (SELECT sum((m * m - s)::DOUBLE / (m - 1)) AS d_o, sum(m)::DOUBLE AS n_all, count(*) AS n_units FROM un), (SELECT sum(n * n)::DOUBLE AS sq FROM (SELECT label, count(*) AS n FROM cod WHERE item_id IN (SELECT item_id FROM un) GROUP BY 1)))""",
    f"{COD}, cn AS (SELECT item_id, label, count(*) AS n FROM cod WHERE label IS NOT NULL GROUP BY 1, 2), un AS (SELECT item_id, sum(n) AS m, sum(n * n) AS s FROM cn GROUP BY 1 HAVING sum(n) >= 2)")
add("label_counts", "SELECT coder, count(*) FILTER (label = '0') AS n_0, count(*) FILTER (label = '1') AS n_1 FROM cod GROUP BY coder", COD)
COD3 = f"""{V}, {vote('vp', names='')}, {vote('u', capitals=False)}, {spans('xa', 'v', 'io')}, {spans('xb', 'vp', 'io')}, {spans('xc', 'u', 'io')},
cs AS (SELECT 'a' AS coder, doc_id, type, start_idx, end_idx FROM xa UNION ALL SELECT 'b', doc_id, type, start_idx, end_idx FROM xb UNION ALL SELECT 'c', doc_id, type, start_idx, end_idx FROM xc),
cp AS (SELECT * FROM (VALUES ('a', 'b'), ('a', 'c'), ('b', 'c')) t(coder_a, coder_b))"""


def pairwise(by_type: bool) -> str:
    t, on = ("type, ", " AND x.type = cpt.type") if by_type else ("", "")
    return f"""SELECT coder_a, coder_b, {t}tp, n_a, n_b, round(CASE WHEN n_a + n_b = 0 THEN 1.0 WHEN n_b = 0 THEN 0.0 ELSE tp::DOUBLE / n_b END, 6) AS precision, round(CASE WHEN n_a + n_b = 0 THEN 1.0 WHEN n_a = 0 THEN 0.0 ELSE tp::DOUBLE / n_a END, 6) AS recall,
  round(CASE WHEN n_a + n_b = 0 THEN 1.0 ELSE 2.0 * tp / (n_a + n_b) END, 6) AS f1 FROM (SELECT coder_a, coder_b, {t}
  (SELECT count(*) FROM cs x JOIN cs y USING (doc_id, type, start_idx, end_idx) WHERE x.coder = coder_a AND y.coder = coder_b{on.replace('x.type', 'type')}) AS tp,
  (SELECT count(*) FROM cs x WHERE x.coder = coder_a{on}) AS n_a, (SELECT count(*) FROM cs x WHERE x.coder = coder_b{on}) AS n_b FROM cpt)"""


add("pairwise_f1", pairwise(False), f"{COD3}, cpt AS (SELECT * FROM cp)")
add("pairwise_f1_by_type", pairwise(True), f"{COD3}, cpt AS (SELECT *, unnest(['Person', 'Location']) AS type FROM cp)")
# corpus
CLS = f"""c0 AS (SELECT *, {corpus_clean('''coalesce(text, '')''')} AS cleaned FROM documents), c1 AS (SELECT *, len({words('cleaned')}) AS n_words FROM c0),
cl AS (SELECT *, CASE WHEN {strip('''coalesce(text, '')''')} = '' THEN 'no_edition' WHEN strpos(lower(lang), 'en') = 0 AND strpos(lower(lang), 'fr') = 0 THEN 'wrong_language' WHEN n_words < 20 THEN 'too_short' WHEN {fraction('cleaned')} > 0.25 THEN 'too_much_lexicon' ELSE 'accepted' END AS reason FROM c1)"""
add("corpus_filter_stats", "SELECT reason, count(*) AS n FROM cl GROUP BY reason", CLS)
add("corpus_totals", "SELECT count(*) AS docs, coalesce(sum(n_words), 0)::BIGINT AS words, coalesce(sum(length(cleaned)), 0)::BIGINT AS chars FROM cl WHERE reason = 'accepted'", CLS)
add("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("gold_join", f"SELECT doc_id, text IS NULL AS missing, {strip('''coalesce(text, '')''')} = '' AS without_edition FROM labels LEFT JOIN documents USING (doc_id)")
add("deterministic_split", """SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents)""")
add("hash_holdout", "SELECT conv_id, turn, CASE WHEN ('0x' || substring(md5(conv_id::VARCHAR || ':' || turn::VARCHAR), 1, 6))::BIGINT < 1677721 THEN 'eval' ELSE 'train' END AS split FROM conversations")
ADJ = """ad AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 10 = 0 THEN CASE WHEN quality = 1 THEN 'a' ELSE 'b' END WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'c' END AS coder,
  CASE WHEN doc_id % 10 = 0 THEN 'adjudicated' ELSE 'unique' END AS kind FROM labels)"""
add("adjudicate", "SELECT item_id, coder, kind FROM ad", ADJ)
add("adjudication_manifest", "SELECT coder, count(*) FILTER (kind = 'unique') AS unique_items, count(*) FILTER (kind = 'adjudicated') AS adjudicated_items, count(*) AS total FROM ad GROUP BY ROLLUP (coder)", ADJ)
TAGW = "tw AS (SELECT doc_id, unnest(s) AS w, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents))"
TAGGED = "CASE WHEN i % 11 = 3 THEN '<persname>' || w || '</persname>' WHEN i % 13 = 5 THEN '<placename>' || w || '</placename>' ELSE w END"
add("section_split", f"SELECT doc_id // 5 AS file, (row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id))::INTEGER AS section_no, doc_id::VARCHAR AS charter_id, md5(body || CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY doc_id // 5) THEN '' ELSE chr(10) END) AS digest FROM (SELECT doc_id, string_agg({TAGGED}, ' ' ORDER BY i) AS body FROM tw GROUP BY doc_id)", TAGW)
TAGL = "CASE WHEN i % 11 = 3 THEN 'Person' WHEN i % 13 = 5 THEN 'Location' ELSE 'O' END"
add("inline_tags_to_labels", r"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY old, idx) - 1)::INTEGER AS idx, text, regexp_matches(text, '^[\p{L}\p{N}_]') AS is_word, io FROM tp",
    f"{TAGW}, tx AS (SELECT doc_id, i AS old, translate(w, 'º°', '  ') AS w, {TAGL} AS io FROM tw), {pieces_of('tp', 'tx', 'doc_id, old, io', 'w')}")
IDS = "ids AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS a FROM documents)"
add("overlap_windows", """SELECT doc_id, k::INTEGER AS window_no, len(w)::INTEGER AS n, list_sum(w)::BIGINT AS total FROM (SELECT doc_id, k, a[k * 126 + 1 : k * 126 + 254] AS w FROM (SELECT doc_id, a, unnest(generate_series(0, greatest(len(a) - 129, 0) // 126)) AS k FROM ids)) WHERE len(w) + 2 >= 7""", IDS)
add("chunk_min_len", "SELECT doc_id, len(a)::INTEGER AS n FROM ids WHERE len(a) >= 7", IDS)
SUBW = f"""{TOK}, {NB}, {CAP}, {vote('vp', names='')}, sw AS (SELECT doc_id, idx, label, text, unnest(CASE WHEN length(text) > 4 THEN [0, 1] ELSE [0] END) AS sub_no FROM vp WHERE is_word),
su AS (SELECT *, CASE WHEN sub_no = 1 THEN '##' || substring(text, 5) WHEN length(text) > 4 THEN substring(text, 1, 4) ELSE text END AS subword FROM sw)"""
add("first_subword_labels", "SELECT doc_id, idx, sub_no, subword, CASE WHEN sub_no = 1 THEN -100 ELSE CASE label WHEN 'O' THEN 0 WHEN 'B-Person' THEN 1 WHEN 'I-Person' THEN 2 WHEN 'B-Location' THEN 3 ELSE 4 END END AS label_id FROM su", SUBW)
add("subword_regroup", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS word_no, text AS word FROM vp WHERE is_word", SUBW)
add("decided_labels", "SELECT vec_id, (list_position(s, list_max(s)) - 1)::INTEGER AS predicted, label AS label_id FROM (SELECT vec_id, embedding AS s, label FROM embeddings WHERE vec_id % 5 <> 0)")
# files, order and samples
add("conll_flatten", f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INTEGER AS idx, text, label FROM se WHERE text <> '{MIDDLE_DOT}'", f"{V}, {SENT}")
add("conll_merge", f"SELECT (doc_id % 2)::INTEGER AS file_no, doc_id, count(DISTINCT sent) AS sentences, count(*) AS tokens FROM se WHERE text <> '{MIDDLE_DOT}' GROUP BY doc_id", f"{V}, {SENT}")
add("label_files_latest", "SELECT doc_id::VARCHAR AS doc_id, 'sdhk_' || doc_id || '_silver.conll' AS file FROM documents")
add("label_files_verified", "SELECT DISTINCT doc_id::VARCHAR AS doc_id FROM documents")
add("gold_edition_texts", f"SELECT doc_id::VARCHAR AS doc_id, md5({CLEAN}) AS digest FROM documents WHERE text IS NOT NULL")
add("review_texts", """SELECT doc_id, sum(n)::BIGINT AS n, md5('--- ' || doc_id || ' (' || sum(n) || ' tokens) ---' || chr(10) || string_agg('  ' || text || CASE WHEN n > 1 THEN '  (x' || n || ')' ELSE '' END, chr(10) ORDER BY first_idx) || chr(10)) AS digest
  FROM (SELECT doc_id, text, count(*) AS n, min(idx) AS first_idx FROM v WHERE reason = 'only_capitalisation_unknown_type' GROUP BY doc_id, text) GROUP BY doc_id""", V)
add("numeric_order", "SELECT id, row_number() OVER (PARTITION BY length(id) ORDER BY try_cast(id AS BIGINT) NULLS LAST, id)::INTEGER AS place FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'x' || page_id ELSE page_id::VARCHAR END AS id FROM pages)")
add("drop_asterisks", "SELECT doc_id, md5(replace(coalesce(text, ''), '*', '')) AS digest FROM documents")
add("class_weights", "SELECT DISTINCT label, CASE label WHEN 'O' THEN 1.0 ELSE 5.0 END::DOUBLE AS weight FROM v", V)
add("sample_rows", "SELECT doc_id, quality FROM labels ORDER BY md5('42|' || doc_id || '|' || quality) LIMIT 20")
# errors: each miss takes the first fitting invention, kind by kind; a step takes one miss of a document
FITS = "CASE phase WHEN 0 THEN x.s = todo[1].s AND x.e = todo[1].e AND x.t <> todo[1].t WHEN 1 THEN x.t = todo[1].t AND x.s <= todo[1].e AND todo[1].s <= x.e ELSE x.t <> todo[1].t AND x.s <= todo[1].e AND todo[1].s <= x.e END"
ERRORS = f"""{CMP},
wr AS (SELECT coalesce(g.doc_id, r.doc_id) AS doc_id, {{'t': coalesce(g.type, r.type), 's': coalesce(g.start_idx, r.start_idx)::BIGINT, 'e': coalesce(g.end_idx, r.end_idx)::BIGINT}} AS span, g.doc_id IS NOT NULL AS ing
  FROM g FULL JOIN r ON g.doc_id = r.doc_id AND g.type = r.type AND g.start_idx = r.start_idx AND g.end_idx = r.end_idx WHERE g.doc_id IS NULL OR r.doc_id IS NULL),
ls AS (SELECT doc_id, coalesce(list(span ORDER BY span) FILTER (ing), []) AS todo, coalesce(list(span ORDER BY span) FILTER (NOT ing), []) AS inv FROM wr GROUP BY doc_id),
st AS (SELECT doc_id, 0 AS phase, 0 AS step, todo, todo[1:0] AS rest, inv, -1 AS hit, todo[1] AS hit_g, todo[1] AS hit_f FROM ls
  UNION ALL SELECT doc_id, CASE WHEN len(todo) = 0 THEN phase + 1 ELSE phase END, step + 1, CASE WHEN len(todo) = 0 THEN rest ELSE todo[2:] END, CASE WHEN len(todo) = 0 THEN todo WHEN f IS NULL THEN list_append(rest, todo[1]) ELSE rest END,
    CASE WHEN f IS NULL THEN inv ELSE list_filter(inv, lambda x: x <> f) END, CASE WHEN f IS NULL THEN -1 ELSE phase END, todo[1], f
  FROM (SELECT *, CASE WHEN len(todo) > 0 THEN list_filter(inv, lambda x: {FITS})[1] END AS f FROM st WHERE phase < 3)),
er AS (SELECT doc_id, ['type_confusion', 'boundary_same_type', 'boundary_and_type'][hit + 1] AS category, hit_g AS g, hit_f AS f FROM st WHERE hit >= 0
  UNION ALL SELECT doc_id, 'pure_miss', unnest(todo), NULL FROM st WHERE phase = 3 UNION ALL SELECT doc_id, 'pure_hallucination', NULL, unnest(inv) FROM st WHERE phase = 3),
err AS (SELECT doc_id, category, g.t AS gold_type, g.s AS gold_start, g.e AS gold_end, f.t AS pred_type, f.s AS pred_start, f.e AS pred_end FROM er)"""
add("error_taxonomy", "SELECT * FROM err", ERRORS, True)
add("error_accounting", "SELECT category, count(*) AS n, CASE WHEN category = 'pure_hallucination' THEN 0 ELSE count(*) END AS fn, CASE WHEN category = 'pure_miss' THEN 0 ELSE count(*) END AS fp FROM err GROUP BY category", ERRORS, True)
add("error_examples", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id, coalesce(gold_start, pred_start), coalesce(gold_end, pred_end), coalesce(gold_type, pred_type), pred_type)::INTEGER AS rank FROM err) WHERE rank <= 5""", ERRORS, True)
# chunks of a text: a step cuts one
TAIL = "substring(text, (greatest(e - 200, pos) + 1)::BIGINT, least(200, e - pos))"
BEHIND = lambda mark, n: f"length({TAIL}) - strpos(reverse({TAIL}), {q(mark[::-1])}) + {n}"
CUT = f"CASE WHEN pos + 1500 >= n THEN e WHEN strpos({TAIL}, '. ') > 0 THEN greatest(e - 200, pos) + {BEHIND('. ', 1)} WHEN strpos({TAIL}, ' ') > 0 THEN greatest(e - 200, pos) + {BEHIND(' ', 1)} ELSE e END"
add("ner_text_chunks", "SELECT doc_id, no::INTEGER AS chunk_no, pos::INTEGER AS chunk_start, (stop - pos)::INTEGER AS n_chars, md5(substring(text, (pos + 1)::BIGINT, stop - pos)) AS digest FROM ch WHERE no >= 0", f"""
tx AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
ch AS (SELECT doc_id, -1 AS no, 0::BIGINT AS pos, 0::BIGINT AS stop, 0::BIGINT AS nxt FROM tx
  UNION ALL SELECT doc_id, no + 1, pos, cut, CASE WHEN pos + 1500 >= n THEN n ELSE greatest(pos + 1, cut - 200) END FROM (SELECT *, {CUT} AS cut FROM (SELECT c.doc_id, c.no, c.nxt AS pos, least(c.nxt + 1500, n) AS e, n, text FROM ch c JOIN tx USING (doc_id) WHERE c.no < 0 OR c.nxt < n)))""".replace("FROM ch WHERE no >= 0", "FROM ch JOIN tx USING (doc_id) WHERE no >= 0"), True)
SQL["ner_text_chunks"] = SQL["ner_text_chunks"].replace("FROM ch WHERE no >= 0", "FROM ch JOIN tx USING (doc_id) WHERE no >= 0")
# a model's entities: words of each chunk with their places
SQL["model_entities"] = SQL["ner_text_chunks"].replace("tx AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL)", "tx AS (SELECT doc_id, replace(text, '*', '') AS text, length(replace(text, '*', '')) AS n FROM documents WHERE text IS NOT NULL)")
_at = SQL["model_entities"].rindex("SELECT doc_id, no::INTEGER AS chunk_no")
SQL["model_entities"] = SQL["model_entities"][:_at] + r"""
, wd AS (SELECT doc_id, no, pos, unnest(w) AS w, unnest(generate_series(1, len(w))) AS i FROM (SELECT doc_id, no, pos, string_split(substring(text, (pos + 1)::BIGINT, stop - pos), ' ') AS w FROM ch JOIN tx USING (doc_id) WHERE no >= 0)),
pl AS (SELECT doc_id, w, pos + sum(length(w) + 1) OVER (PARTITION BY doc_id, no ORDER BY i) - length(w) - 1 AS s FROM wd),
en AS (SELECT DISTINCT doc_id, w, s FROM pl WHERE regexp_full_match(w, '[A-Z][a-z]{6,}'))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, s + length(w)) - 1)::INTEGER AS ord, w AS text, CASE WHEN length(w) % 2 = 0 THEN 'PER' ELSE 'LOC' END AS ner_label,
  CASE WHEN length(w) % 2 = 0 THEN 'Person' ELSE 'Location' END AS mapped_label, 'entities' AS bucket, round(0.5 + length(w) / 128, 4) AS score, s::INTEGER AS start_at, (s + length(w))::INTEGER AS end_at FROM en"""
# sentences cut at O: a fold over a document's tokens, whose accumulator has the shape of its items
FOLD = "{'first': %s, 'at': %s, 'used': %s, 'cut': %s, 'since': %s, 'out': %s, 'o': %s, 'size': %s}"
NOTHING = "[]::STRUCT(a BIGINT, b BIGINT)[]"
FULL, AT_O = "(acc.used > 0 AND acc.used + x.size > 254)", "(acc.used > 0 AND acc.used + x.size > 254 AND acc.cut > 0)"
FIRST = f"(CASE WHEN {AT_O} THEN acc.cut WHEN {FULL} THEN acc.at ELSE acc.first END)"
USED = f"(CASE WHEN {AT_O} THEN acc.since WHEN {FULL} THEN 0 ELSE acc.used END)"
AGAIN = f"({USED} > 0 AND {USED} + x.size > 254)"
FIRST2, USED2 = f"(CASE WHEN {AGAIN} THEN acc.at ELSE {FIRST} END)", f"(CASE WHEN {AGAIN} THEN 0 ELSE {USED} END)"
OUT = f"list_concat(list_concat(acc.out, CASE WHEN {FULL} THEN [{{'a': acc.first, 'b': {FIRST}}}] ELSE {NOTHING} END), CASE WHEN {AGAIN} THEN [{{'a': {FIRST}, 'b': acc.at}}] ELSE {NOTHING} END)"
O_HERE = f"(x.o AND acc.at > {FIRST2})"
STEP = FOLD % (f"{FIRST2}::BIGINT", "(acc.at + 1)::BIGINT", f"({USED2} + x.size)::BIGINT", f"(CASE WHEN {O_HERE} THEN acc.at + 1 WHEN {FULL} OR {AGAIN} THEN -1 ELSE acc.cut END)::BIGINT", f"(CASE WHEN {O_HERE} THEN 0 ELSE CASE WHEN {FULL} OR {AGAIN} THEN {USED2} ELSE acc.since END + x.size END)::BIGINT", OUT, "false", "0::BIGINT")
START = FOLD % ("0::BIGINT", "0::BIGINT", "0::BIGINT", "-1::BIGINT", "0::BIGINT", NOTHING, "false", "0::BIGINT")
ITEM = FOLD % ("0::BIGINT", "0::BIGINT", "0::BIGINT", "-1::BIGINT", "0::BIGINT", NOTHING, "label = 'O'", "greatest(1, length(text))::BIGINT")
add("o_boundary_chunks", "SELECT doc_id, (no - 1)::INTEGER AS chunk_no, c.a::INTEGER AS first_pos, c.b::INTEGER AS last_pos FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS no FROM ck)", f"""{V},
tl AS (SELECT doc_id, list({ITEM} ORDER BY idx) AS items, sum(greatest(1, length(text))) AS total FROM v GROUP BY doc_id),
fd AS (SELECT doc_id, total, len(items) AS n, list_reduce(list_prepend({START}, items), lambda acc, x: {STEP}) AS f FROM tl),
ck AS (SELECT doc_id, CASE WHEN total <= 254 THEN [{{'a': 0::BIGINT, 'b': n}}] ELSE list_append(f.out, {{'a': f.first, 'b': f.at}}) END AS chunks FROM fd)""")


# votes on all three signals, similar names among them
def fuzzy_signal(name: str, places: str, persons: str) -> str:
    own = f"{CAPITAL} AND length(t.text) >= 4"
    side = lambda k: f"CASE WHEN {k}.level = 'exact' OR ({own.replace('text,', 't.text,')}) THEN {k}.score END"
    return f"""{name} AS (SELECT doc_id, idx, CASE WHEN coalesce(ls, -1) >= coalesce(ps, -1) THEN 'Location' ELSE 'Person' END AS label FROM (
  SELECT t.doc_id, t.idx, {STOP.replace('text', 't.text')} AS stop, {side('a')} AS ls, {side('b')} AS ps FROM tok t LEFT JOIN {places} a ON lower(t.text) = a.word_lower LEFT JOIN {persons} b ON lower(t.text) = b.word_lower WHERE t.is_word)
  WHERE stop IS NULL AND (ls IS NOT NULL OR ps IS NOT NULL))"""


CLAIMS = """s1 AS (SELECT doc_id, idx, CASE WHEN ord % 2 = 0 THEN 'Person' ELSE 'Location' END AS label FROM (SELECT doc_id, unnest(locs) AS idx, ord FROM ent JOIN (SELECT * FROM rk WHERE rank = 1) USING (doc_id, entity)) QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY ord) = 1)"""
BASE_EVERY = f"{TOK},\n{NB},\n{CAP},\n{NAMES},\n{MATCH_REST},\n{CLAIMS},\n{CAPWORDS}, {HITS('hl', 'plc')}, {HITS('hp', 'per')},\n{fuzzy_signal('s2', 'hl', 'hp')}"
V_EVERY = f"{BASE_EVERY},\n{vote('v', entities='s1')}"
GP_EVERY = f"{V_EVERY}, per_lo AS (SELECT * FROM per WHERE name_lower < 'm'), {HITS('ho', 'per_lo')},\n{fuzzy_signal('s2p', 'ho', 'hl')},\n{vote('vp', names='s2p')}"
for _name in ("vote_labels", "vote_reasons", "signal_combinations", "vote_summary", "review_unknown_tokens", "doc_summary", "io_spans", "bio_spans", "seqeval_spans", "conll_emit", "conll_read_sentences", "conll_parse_entities", "metrics_entity", "metrics_entity_avg", "metrics_token", "metrics_token_avg"):
    SQL[f"{_name}_every_signal"] = SQL[_name].replace(GP, GP_EVERY).replace(V, V_EVERY)
for _name in ("sentence_initial", "neighbour_words", "vote_labels", "io_spans", "bio_spans", "seqeval_spans", "o_boundary_chunks"):
    SQL[f"{_name}_by_segments"] = SQL[_name]
