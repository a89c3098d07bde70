"""SQL for DuckDB that states the same results over the same tables.

Written apart from the library: plain joins, CASE chains and recursion over
line numbers. Only fixed values and marker patterns are shared with it.
"""

from __future__ import annotations

from massmap.functions import fixed_values as V
from massmap.functions.lines import PATTERNS
from massmap.sources import adapters as A


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return "(" + ", ".join(q(item) for item in items) + ")"


def array(items) -> str:
    return "[" + ", ".join(q(item) for item in items) + "]"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def case_of(column: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {q(key)} THEN {q(value)}" for key, value in table.items())
    return f"CASE {column} {whens} END"


def trim(column: str) -> str:
    return f"regexp_replace({column}, {q(f'^[{V.SPACE}]+|[{V.SPACE}]+$')}, '', 'g')"


def utf16(column: str) -> str:
    return f"(length({column}) + length(regexp_replace({column}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tokens(column: str) -> str:
    return f"len(regexp_extract_all({column}, {q(V.PRE_TOKEN)}))::BIGINT"


def split_lines(column: str) -> str:
    return (
        f"CASE WHEN {column} = '' THEN []::VARCHAR[] WHEN {column}[-1] = chr(10) "
        f"THEN string_split({column}, chr(10))[1:-2] ELSE string_split({column}, chr(10)) END"
    )


def locale_name(column: str) -> str:
    part = [f"regexp_extract({column}, {q(V.LOCALE_NAME)}, {group})" for group in range(4)]
    return (
        f"({part[1]} IN {values(V.LANGUAGE_CODES + V.LEGACY_LANGUAGE_CODES)} AND CASE WHEN {part[3]} <> '' "
        f"THEN {part[2]} IN {values(V.SCRIPT_CODES)} AND {part[3]} IN {values(V.REGION_CODES)} "
        f"ELSE {part[2]} = '' OR {part[2]} IN {values(V.REGION_CODES + V.SCRIPT_CODES)} END)"
    )


def regioned(column: str) -> str:
    return f"({locale_name(column)} AND regexp_extract({column}, {q(V.LOCALE_NAME)}, 2) <> '')"


def base(column: str) -> str:
    return f"regexp_extract({column}, '([^/]*)$', 1)"


def folder(column: str) -> str:
    return f"regexp_extract({column}, '(?s)^(.*)/[^/]*$', 1)"


def folders_above(column: str) -> str:
    """Root first, as a list."""
    parts = f"string_split({column}, '/')"
    return (
        f"list_transform(range(0, len({parts})), lambda n: coalesce(array_to_string({parts}[1:n], '/'), ''))"
    )


def content_hash(column: str) -> str:
    return (
        f"({rx(column, '^[A-Za-z0-9_]{8,}$')} AND CASE WHEN {rx(column, '^[0-9a-f]+$')} "
        f"THEN {rx(column, '[0-9]')} AND {rx(column, '[a-f]')} ELSE {rx(column, '[a-z]')} AND {rx(column, '[A-Z]')} END)"
    )


def interpreter(text: str) -> str:
    line = trim(f"regexp_extract({text}, '^#!([^\\n]*)', 1)")
    words = f"list_filter(regexp_split_to_array({line}, {q(f'[{V.SPACE}]+')}), lambda w: w <> '')"
    first = f"lower({base(f'{words}[1]')})"
    second = f"lower({base(f'''list_filter({words}[2:], lambda w: NOT starts_with(w, '-'))[1]''')})"
    name = f"CASE WHEN {first} = 'env' THEN {second} ELSE {first} END"
    plain = f"regexp_replace({name}, {q(V.INTERPRETER_VERSION)}, '')"
    return f"CASE WHEN starts_with({text}, '#!') THEN CASE WHEN {plain} = '' THEN {name} ELSE {plain} END END"


def generated_header(text: str) -> str:
    marker = "(?i)" + "|".join(f"(?:{p})" for p in V.GENERATED_HEADERS)
    words = (
        f"regexp_replace(regexp_replace(l, {q(V.COMMENT_OPENING)}, ''), {q(V.HEADER_NOTICE)}, '')"
    )
    return (
        f"len(list_filter(string_split(substr({text}, 1, 2000), chr(10))[1:8], "
        f"lambda l: {rx('l', V.COMMENT_OPENING)} AND {rx(words, marker)})) > 0"
    )


def html_generator(lower_ext: str, text: str) -> str:
    head = f"array_to_string(string_split(substr({text}, 1, 10000), chr(10))[1:30], chr(10))"
    tags = f"regexp_extract_all({head}, {q(V.HTML_META_TAG)})"
    return (
        f"({lower_ext} IN {values(V.HTML_EXTENSIONS)} AND "
        f"len(list_filter({tags}, lambda t: {rx('t', V.HTML_GENERATOR_NAME)})) > 0)"
    )


def minified(text: str) -> str:
    sizes = f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: {utf16(trim('l'))}), lambda n: n > 0)"
    return f"({utf16(text)} >= 2000 AND len({sizes}) > 0 AND list_sum({sizes}) >= len({sizes}) * 500)"


def verdicts_cte(source: str, key: str, name: str = "verdicts") -> str:
    """Line verdicts by recursion over line numbers.

    ``source`` must hold ``key``, ``text`` and ``syntax``. Two CTEs result:
    ``<name>`` with one letter per line and ``<name>_lines`` with the lines.
    """
    rows = ", ".join(
        "(" + ", ".join(
            q(part.replace("*+", "*"))
            for part in (syntax, p["keep"], p["state"], p["opened"], p["opened_span"])
        ) + ")"
        for syntax, p in PATTERNS.items()
    )
    left = r"regexp_replace(s.open || l.line, m.state, chr(1) || '\1' || chr(2) || '\2', 'g')"
    return f"""
{name}_markers(syntax, keep, state, opened, opened_span) AS (VALUES {rows}),
{name}_lines AS (
  SELECT {key}, syntax, u.n, u.line FROM (SELECT {key}, syntax, {split_lines('text')} AS all_lines FROM {source}) t,
  LATERAL (SELECT unnest(range(1, len(t.all_lines) + 1)) AS n, unnest(t.all_lines) AS line) u),
{name}_scan AS (
  SELECT {key}, 0::BIGINT AS n, ''::VARCHAR AS open, ''::VARCHAR AS verdict FROM {source}
  UNION ALL
  SELECT s.{key}, l.n,
    CASE WHEN NOT {rx('l.line', f'[^{V.SPACE}]')} OR l.syntax IS NULL THEN s.open
         WHEN regexp_extract({left}, m.opened, 1) <> '' THEN regexp_extract({left}, m.opened, 1)
         WHEN regexp_extract({left}, m.opened_span, 1) <> '' THEN '=' || regexp_extract({left}, m.opened_span, 1)
         ELSE '' END,
    CASE WHEN NOT {rx('l.line', f'[^{V.SPACE}]')} THEN 'b' WHEN l.syntax IS NULL THEN 'c'
         WHEN regexp_matches(regexp_replace(s.open || l.line, m.keep, '\\1', 'g'), {q(f'[^{V.SPACE}]')}) THEN 'c'
         ELSE 'm' END
  FROM {name}_scan s JOIN {name}_lines l ON l.{key} = s.{key} AND l.n = s.n + 1
  LEFT JOIN {name}_markers m ON m.syntax = l.syntax),
{name} AS (SELECT {key}, n, verdict FROM {name}_scan WHERE n > 0)"""


CORPUS = f"""
corpus AS (
  SELECT source AS repo, doc_id,
    'm' || (doc_id // {len(A.FOLDERS) * len(A.NAMES)}) || '/' || ({array(A.FOLDERS)})[1 + doc_id % {len(A.FOLDERS)}]
      || '/' || ({array(A.NAMES)})[1 + doc_id % {len(A.NAMES)}] AS path,
    ({array(A.HEADERS)})[1 + doc_id % {len(A.HEADERS)}] || text AS text
  FROM documents)"""

PARTS = f"""
parts AS (
  SELECT *, {base('path')} AS name, lower({base('path')}) AS lname,
    regexp_extract(lower({base('path')}), {q(V.EXTENSION)}, 1) AS ext,
    {folder('path')} AS folder,
    list_filter(string_split(lower(path), '/')[1:-2], lambda d: d <> '' AND d <> '.') AS dirs
  FROM corpus),
named AS (
  SELECT *, substr(name, 1, length(name) - length(ext)) AS stem, substr(lname, 1, length(lname) - length(ext)) AS lstem,
    coalesce(array_to_string(dirs, '/'), '') AS dir
  FROM parts)"""

LEVELS = f"""
entries AS (
  SELECT DISTINCT repo, dir, lstem AS entry FROM named
  UNION
  SELECT DISTINCT repo, coalesce(array_to_string(dirs[1:i - 1], '/'), ''), dirs[i]
  FROM (SELECT repo, dirs, unnest(range(1, len(dirs) + 1)) AS i FROM named)),
levels AS (
  SELECT repo, dir FROM entries GROUP BY repo, dir
  HAVING {base('dir')} IN {values(V.I18N_FOLDERS)}
    OR (bool_and({rx('entry', V.LOCALE_NAME)}) AND count(*) FILTER ({locale_name('entry')}) >= 2
        AND count(*) FILTER ({locale_name('entry')}) >= count(*) * 0.9))"""

COPIES = f"""
inside_level AS (
  SELECT DISTINCT p.doc_id FROM (SELECT doc_id, repo, dirs, unnest(range(1, len(dirs) + 1)) AS i FROM named) p
  JOIN levels v ON v.repo = p.repo AND v.dir = coalesce(array_to_string(p.dirs[1:p.i - 1], '/'), '')
  WHERE {locale_name('p.dirs[p.i]')}),
copies AS (
  SELECT n.*, {regioned('n.lstem')} OR len(list_filter(n.dirs, lambda d: {regioned('d')})) > 0
      OR n.doc_id IN (SELECT doc_id FROM inside_level)
      OR ({locale_name('n.lstem')} AND v.dir IS NOT NULL) AS locale_copy
  FROM named n LEFT JOIN levels v ON v.repo = n.repo AND v.dir = n.dir)"""

NAMED_LIKE_TEST = rx("lname", V.TEST_PREFIX_OR_SUFFIX)
STEMMED_LIKE_TEST = f"({rx('stem', V.SEPARATED_TEST_STEM)} OR {rx('stem', V.CAMEL_TEST_STEM)})"

KIND = f"""CASE WHEN ext IN {values(V.I18N_EXTENSIONS)} THEN 'i18n'
  WHEN {NAMED_LIKE_TEST} THEN 'test' WHEN locale_copy THEN 'i18n'
  WHEN lname IN {values(V.DATA_NAMES)} THEN 'data' WHEN lname IN {values(V.TEXT_NAMES)} THEN 'text'
  WHEN ext IN {values(V.DATA_EXTENSIONS)} THEN CASE WHEN list_has_any(dirs, {array(V.I18N_FOLDERS)}) THEN 'i18n' ELSE 'data' END
  WHEN ext IN {values(V.TEXT_EXTENSIONS)} THEN CASE WHEN list_has_any(dirs, {array(V.FIXTURE_FOLDERS)}) THEN 'data' ELSE 'text' END
  WHEN ext IN {values(V.CODE_EXTENSIONS)} THEN CASE WHEN {STEMMED_LIKE_TEST} OR list_has_any(dirs, {array(V.TEST_FOLDERS)}) THEN 'test' ELSE 'code' END
  WHEN ext IN {values(V.OTHER_EXTENSIONS)} THEN 'other' ELSE 'code' END"""

GENERATED_BY_PATH = f"""(list_has_any(dirs, {array(V.GENERATED_FOLDERS)}) OR lname IN {values(V.GENERATED_NAMES)}
  OR {rx('lname', V.GENERATED_NAME_FAMILY)}
  OR len(list_filter({array(V.GENERATED_SUFFIXES)}, lambda x: suffix(lname, x))) > 0
  OR (ext IN {values(V.BUNDLE_EXTENSIONS)} AND
      len(list_filter(regexp_split_to_array(stem, {q(V.STEM_SEPARATOR)})[2:], lambda s: {content_hash('s')})) > 0)
  OR {rx('stem', V.GENERATED_STEM)})"""

GENERATED_BY_CONTENT = f"""(NOT {rx('path', V.PATCH_FILE)} AND ({generated_header('text')} OR {html_generator('ext', 'text')}
  OR (ext IN {values(V.BUNDLE_EXTENSIONS)} AND ({rx('text', V.SOURCE_MAP_COMMENT)} OR {minified('text')}))))"""

LANGUAGE = f"""coalesce({case_of('ext', V.LANGUAGE_BY_EXTENSION)},
  CASE WHEN {interpreter('text')} IN {values(V.SHELL_INTERPRETERS)} THEN 'bash' END)"""

COMMENT_SYNTAX = f"""coalesce(CASE WHEN {rx('lname', V.SYNTAX_NAME_PREFIX)} THEN 'hash' END,
  {case_of('lname', V.SYNTAX_BY_NAME)}, {case_of('ext', V.SYNTAX_BY_EXTENSION)},
  CASE WHEN {interpreter('text')} IN {values(V.HASH_INTERPRETERS)} THEN 'hash' END)"""


# RE2 ends a word at an accented letter and Java does not; spell them as a letter here.
ACCENTED = "regexp_replace(bare, '[\\x{00C0}-\\x{024F}]', 'x', 'g')"


def _by_language(which: int) -> str:
    whens = " ".join(
        f"WHEN {q(name)} THEN len(regexp_extract_all({ACCENTED}, {q(patterns[which])}))"
        for name, patterns in V.STRUCTURE_PATTERNS.items()
        if patterns[which] is not None
    )
    return f"coalesce(CASE language {whens} END, 0)::BIGINT"


WHOLE = "whole_markers(language, whole) AS (VALUES " + ", ".join(
    f"({q(name)}, {q(PATTERNS[name]['whole'].replace('*+', '*'))})" for name in V.LANGUAGE_SYNTAXES
) + ")"

SOLID = "regexp_replace({0}, '[\\x00-\\x20]', '', 'g')"

# Every measured figure of the corpus: the SQL twin of a scan.
FILES = f"""
syntaxes AS (SELECT c.*, {LANGUAGE} AS language, {COMMENT_SYNTAX} AS format_syntax FROM copies c),
sources AS (SELECT *, coalesce(language, format_syntax) AS syntax FROM syntaxes),
{WHOLE},
{verdicts_cte('sources', 'doc_id')},
line_totals AS (
  SELECT doc_id, count(*) FILTER (verdict = 'c') AS code_lines, count(*) FILTER (verdict = 'm') AS comment_lines,
    count(*) FILTER (verdict = 'b') AS blank_lines FROM verdicts GROUP BY doc_id),
shapes AS (
  SELECT s.*, regexp_replace(s.text, w.whole, ' ', 'g') AS bare,
    {utf16(SOLID.format(r"regexp_replace(s.text, w.whole, '\1', 'g')"))} AS content_chars,
    list_transform(list_filter(regexp_extract_all(s.text, w.whole, 1), lambda x: x <> ''),
                   lambda x: {utf16(SOLID.format('x'))}) AS sizes
  FROM sources s LEFT JOIN whole_markers w ON w.language = s.language),
files AS (
  SELECT s.repo, s.doc_id, s.path, s.name, s.folder, s.language, s.text, s.dirs, s.ext,
    CASE WHEN ({KIND}) = 'code' AND s.language IS NOT NULL AND s.language NOT IN {values(V.QUOTING_LANGUAGES)}
        AND s.content_chars >= 1000 AND coalesce(list_sum(s.sizes), 0) >= s.content_chars * 0.9
        AND coalesce(list_max(s.sizes), 0) <= coalesce(list_sum(s.sizes), 0) * 0.25
      THEN CASE WHEN {rx('lower(s.path)', V.I18N_PATH)} THEN 'i18n' ELSE 'data' END ELSE ({KIND}) END AS kind,
    {GENERATED_BY_PATH} OR {GENERATED_BY_CONTENT} AS generated,
    {KIND} AS path_kind, {GENERATED_BY_PATH} AS path_generated,
    {tokens('s.text')} AS tokens,
    coalesce(t.code_lines + t.comment_lines, 0)::BIGINT AS lines, coalesce(t.code_lines, 0)::BIGINT AS code_lines,
    coalesce(t.comment_lines, 0)::BIGINT AS comment_lines, coalesce(t.blank_lines, 0)::BIGINT AS blank_lines,
    {_by_language(0)} AS functions, {_by_language(1)} AS classes, {_by_language(2)} AS branches,
    coalesce(s.content_chars, 0)::BIGINT AS content_chars, coalesce(list_sum(s.sizes), 0)::BIGINT AS literal_chars,
    coalesce(list_max(s.sizes), 0)::BIGINT AS largest_literal
  FROM shapes s LEFT JOIN line_totals t USING (doc_id)),
flavored AS (SELECT *, CASE WHEN generated THEN 'generated' ELSE kind END AS flavor FROM files)"""

# The byte snapshots: who is read, then the measured figures of those who are.
ADMISSION = f"""
admission AS (
  SELECT doc_id, CASE WHEN list_contains(string_split(path, '/')[1:-2], 'config') THEN 'excluded'
    WHEN doc_id % 7 = 3 THEN 'symlink' WHEN doc_id % 7 = 5 THEN 'submodule' WHEN doc_id % 11 = 7 THEN 'unreadable'
    WHEN doc_id % 11 IN (4, 6) THEN 'binary' WHEN doc_id % 11 = 5 THEN 'unsupported-encoding' ELSE 'measured' END AS measurement
  FROM corpus)"""

FIGURES = ["tokens", "lines", "code_lines", "comment_lines", "blank_lines", "functions", "classes", "branches"]
ROWS = f"""{ADMISSION},
rows AS (
  SELECT f.repo, f.doc_id, f.path, f.name, f.folder, a.measurement, a.measurement = 'measured' AS is_measured,
    CASE WHEN a.measurement = 'measured' THEN f.kind ELSE f.path_kind END AS kind,
    CASE WHEN a.measurement = 'measured' THEN f.generated ELSE f.path_generated END AS generated,
    CASE WHEN a.measurement = 'measured' THEN CASE WHEN f.generated THEN 'generated' ELSE f.kind END
      ELSE CASE WHEN f.path_generated THEN 'generated' ELSE f.path_kind END END AS flavor,
    CASE WHEN a.measurement = 'measured' THEN f.language END AS language,
    {", ".join(f"CASE WHEN a.measurement = 'measured' THEN f.{name} END AS {name}" for name in FIGURES)}
  FROM files f JOIN admission a USING (doc_id))"""

CLASSIFIED = f"{CORPUS},{PARTS},{LEVELS},{COPIES}"
MEASURED = f"{CLASSIFIED},{FILES}"
SCANNED = f"{MEASURED},{ROWS}"


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"
