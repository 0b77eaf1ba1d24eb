"""For each query the SQL, as DuckDB runs it on the shared tables, that gives the same rows."""

from __future__ import annotations

_NL = "chr(10)"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CEIL4 = "((length({0}) + 3) // 4)::bigint"


def _tenths(n: str, unit: int) -> str:
    q, r = f"(({n}) * 10 // {unit})", f"(({n}) * 10 % {unit})"
    t = f"({q} + case when {r} * 2 > {unit} or ({r} * 2 = {unit} and {q} % 2 = 1) then 1 else 0 end)"
    return f"({t} // 10)::varchar || '.' || ({t} % 10)::varchar"


def _count(n: str) -> str:
    return f"case when {n} < 1000 then ({n})::varchar else {_tenths(n, 1000)} || 'k' end"


def _bytes(n: str, units: list[str]) -> str:
    out = f"({n})::varchar || '{units[0]}'"
    for power, unit in enumerate(units[1:], 1):
        out = f"case when {n} >= {1024**power} then {_tenths(n, 1024**power)} || '{unit}' else {out} end"
    return out


_LOGS = """lines as (
  select user_id, row_number() over (partition by user_id order by ts, event_id) as line_no,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' event ' || event_id as line
  from events
)"""
_ERROR = r"regexp_matches(line, '(?i)(^|[^0-9A-Za-z_])(FAIL|ERROR|FATAL|PANIC|EXCEPTION|TRACEBACK)($|[^0-9A-Za-z_])')"
_SUMMARY = f"""{_LOGS}, near as (
  select *, max({_ERROR}::int) over (partition by user_id order by line_no rows between 2 preceding and 2 following) as kept from lines
), runs as (
  select *, sum(kept) over (partition by user_id order by line_no) as run from near
), summary as (
  select user_id, line_no, line from runs where kept = 1
  union all
  select user_id, min(line_no), case when count(*) = 1 then min(line) else '... ' || count(*) || ' lines omitted ...' end from runs where kept = 0 group by user_id, run
)"""
_MARKDOWN = """md as (
  select conv_id, '# Conversation ' || conv_id || chr(10) || chr(10)
    || string_agg(case when role = 'user' then '## ' else '### ' end || 'Turn ' || turn || ' ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn, role, text) as md
  from conversations group by conv_id
), cut as (
  select conv_id, length(md) as total, md, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) as line_no from md
), placed as (
  select *, sum(length(line) + 1) over (partition by conv_id order by line_no) - length(line) - 1 as start from cut
), heads as (
  select conv_id, total, md, line_no, start::bigint as start, length(regexp_extract(line, '^ {0,3}(#{1,6})[ \\t]', 1))::int as level,
    trim(regexp_extract(line, '^ {0,3}#{1,6}[ \\t]+(.*?)[ \\t#]*$', 1)) as title, row_number() over (partition by conv_id order by line_no)::int as id
  from placed where regexp_matches(line, '^ {0,3}#{1,6}[ \\t]+[^ \\t#]')
), headings as (
  select a.conv_id, a.id, a.level, a.title, a.line_no, a.start, any_value(a.total) as total, any_value(a.md) as md, coalesce(min(b.start), any_value(a.total)) as stop
  from heads a left join heads b on a.conv_id = b.conv_id and b.id > a.id and b.level <= a.level group by a.conv_id, a.id, a.level, a.title, a.line_no, a.start
), sized as (
  select *, ((stop - start + 3) // 4)::bigint as n_tokens from headings
)"""
_DOCS = """docs as (
  select o_orderkey as id, o_orderstatus as status, {'key': o_custkey, 'priority': o_orderpriority} as owner,
    list({'n': l_linenumber, 'part': l_partkey, 'qty': l_quantity::bigint} order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as items
  from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_orderstatus, o_custkey, o_orderpriority
)"""
_ENTRIES = """entries as (
  select c_custkey, [{'k': 'name', 'v': c_name}, {'k': 'segment', 'v': nullif(c_mktsegment, 'BUILDING')}, {'k': 'nation', 'v': case when c_nationkey % 3 = 0 then '' else c_nationkey::varchar end}] as entries
  from customer
)"""
_DIFFS = rf"""turns as (
  select conv_id, turn, text, case when turn % 3 = 0 then replace(text, ' ', '  ') else translate(text, '{_LOWER}', '{_UPPER}') end as new from conversations
), hunks as (
  select conv_id, turn, row_number() over (partition by conv_id order by turn) as hunk_no, len(string_split(text, {_NL})) as n,
    regexp_replace(text, '\s+', '', 'g') = regexp_replace(new, '\s+', '', 'g') as ws_only,
    '@@ -' || turn || ' +' || turn || ' @@' || {_NL} || '-' || replace(text, {_NL}, {_NL} || '-') || {_NL} || '+' || replace(new, {_NL}, {_NL} || '+') as body
  from turns
), files as (
  select conv_id, 1::bigint as file_no, sum(n)::bigint as n, string_agg(body, {_NL} order by turn) as every, string_agg(body, {_NL} order by turn) filter (not ws_only) as body, count(*) filter (ws_only) as skipped from hunks group by conv_id
), fenced as (
  select *, repeat('`', greatest(4, coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda x: length(x))), 0) + 1)) as mark from files
), diffs as (
  select conv_id, '**2 file(s) changed** (+' || (n + 1) || ' -' || n || ')' || {_NL} || {_NL} || '## c' || conv_id || '.txt (modified, +' || n || ' -' || n || ')'
      || case when body is null then '' else {_NL} || {_NL} || mark || 'diff' || {_NL} || body || {_NL} || mark end
      || case when skipped > 0 then {_NL} || {_NL} || '[' || skipped || ' whitespace-only hunk(s) omitted]' else '' end
      || {_NL} || {_NL} || '## new-c' || conv_id || '.txt (new, +1 -0)' || {_NL} || {_NL} || '````diff' || {_NL} || '@@ -0,0 +1 @@' || {_NL} || '+one line' || {_NL} || '````' as markdown,
    array_to_string(['diff --git a/c' || conv_id || '.txt b/c' || conv_id || '.txt', '--- a/c' || conv_id || '.txt', '+++ b/c' || conv_id || '.txt', every,
      'diff --git a/new-c' || conv_id || '.txt b/new-c' || conv_id || '.txt', 'new file mode 100644', '--- /dev/null', '+++ b/new-c' || conv_id || '.txt', '@@ -0,0 +1 @@', '+one line'], {_NL}) as raw
  from fenced
)"""
_PAGED = """cut as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents
), body as (
  select doc_id, ((line_no - 1) // 6 + 1)::bigint as page_no, line_no::bigint as line_no, line from cut
), paged as (
  select * from body
  union all select distinct doc_id, page_no, 0, 'Corpus report, part ' || page_no from body
  union all select distinct doc_id, page_no, 1000000, '- ' || (page_no + 2) || ' -' from body
), placed as (
  select *, row_number() over (partition by doc_id, page_no order by line_no) as top, row_number() over (partition by doc_id, page_no order by line_no desc) as bottom,
    count(*) over (partition by doc_id, page_no) as n
  from paged where regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
), counts as (
  select doc_id, max(page_no) as pages from paged group by doc_id
), edges as (
  select p.*, pages, case when top <= 2 then 'top:' else 'bottom:' end || regexp_replace(regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '[0-9]+', '#', 'g') as key
  from placed p join counts using (doc_id) where n >= 5 and least(top, bottom) <= 2 and regexp_matches(line, '\\pL.*\\pL.*\\pL')
), repeated as (
  select doc_id, key, count(distinct page_no)::bigint as n_pages from edges group by doc_id, key, pages having pages >= 4 and count(distinct page_no) >= greatest(3, pages * 6 // 10)
), numbers as (
  select doc_id, page_no, line_no, pages, regexp_extract(line, '(?i)^[\\t\\n\\f\\r –—-]*(?:page[\\t\\n\\f\\r ]*)?([0-9]+)(?:[\\t\\n\\f\\r ]*(?:of|/)[\\t\\n\\f\\r ]*[0-9]+)?[\\t\\n\\f\\r –—-]*$', 1) as digits
  from placed join counts using (doc_id) where top = 1 or bottom = 1
), valued as (
  select doc_id, page_no, line_no, pages, try_cast(digits as bigint) as value from numbers where digits <> '' and try_cast(digits as bigint) is not null
), offsets as (
  select doc_id, value - page_no as page_offset, pages, count(*)::bigint as n from valued group by all
), best as (
  select doc_id, page_offset, n from (select *, row_number() over (partition by doc_id order by n desc, abs(page_offset), page_offset) as place from offsets)
  where place = 1 and pages >= 4 and n >= greatest(2, pages // 2)
)"""
_GRID = """grid as (
  select r_name as sheet, n_nationkey * 2 as row_no, n_name as name, n_nationkey::varchar as number from nation join region on n_regionkey = r_regionkey
)"""
_STYLES = """with recursive styles as (
  select n_nationkey::bigint as style_id, case when n_nationkey > 0 then (n_nationkey // 2)::bigint end as based_on, case when n_nationkey % 4 = 0 then n_name end as font from nation
), chain(style_id, hop, ancestor) as (
  select style_id, 0, style_id from styles
  union all
  select c.style_id, c.hop + 1, s.based_on from chain c join styles s on c.ancestor = s.style_id where s.based_on is not null and c.hop < 10
)"""
_SITE = """split as (
  select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') as path, length(html)::bigint as size from pages
), files as (
  select regexp_extract(host, '([^.]+[.][^.]+)$', 1) as root, path, max(size) as size from split where path <> '' group by all
), steps as (
  select root, path, string_split(path, '/') as parts, unnest(range(1, len(string_split(path, '/')) + 1)) as depth from files
), entries as (
  select root, case when depth = 1 then '' else array_to_string(parts[1:depth - 1], '/') end as parent, parts[depth] as name, max(depth < len(parts)) as is_dir from steps group by all
)"""


#: Charsets of the query on them: name, text with signs of it, codec; the last has no table.
SAMPLES = [("windows-1252", "“Œuvre” – 5 €", "cp1252"), ("windows-1251", "Привет, мир №5", "cp1251"), ("iso-8859-2", "Źródło łąki", "iso8859_2"), ("koi8-r", "Добрый день", "koi8_r"), ("iso-8859-15", "Žižka 7 €", "iso8859_15"), ("x-unheard-of", "naïve", "latin-1")]


def _sample(of) -> str:
    """A case over the charset of a document."""
    return "case doc_id % 6 " + " ".join(f"when {k} then '{of(k)}'" for k in range(6)) + " end"


def _as_named(k: int) -> str:
    return SAMPLES[k][1] if k < 5 else "na\ufffdve"


def _as_windows(raw: bytes) -> str:
    """Bytes as windows-1252, where a byte without a sign is the control sign of its number."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)


_STRIPPED = "html"
for _tag in "script style noscript template svg canvas iframe object embed picture video audio button select textarea dialog".split():
    _STRIPPED = rf"regexp_replace({_STRIPPED}, '(?is)<{_tag}(\s[^>]*)?>.*?</{_tag}>', ' ', 'g')"
_STRIPPED = rf"trim(regexp_replace(regexp_replace(regexp_replace({_STRIPPED}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s\x0B\x{{A0}}]+', ' ', 'g'))"


def _stripped() -> str:
    return _STRIPPED


def _replaced(text: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return text


#: What the shared pages hold, told by itself: scripts, styles, comments and an article of headings, paragraphs, bold words, lists, links and breaks.
_PAGES = rf"""heads as (
  select page_id, html, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) as title,
    regexp_extract({_replaced("html", ("(?s)<!--.*?-->", "' '"), ("(?is)<script(>|\\s[^>]*>).*?</script>", "' '"), ("(?is)<style(>|\\s[^>]*>).*?</style>", "' '"))}, '(?is)<article>(.*)</article>', 1) as body
  from pages
), flowed as (
  select *, {_replaced("body", ("[\\s\\x{A0}]+", "' '"), ("(?i)<h1> ?(.*?) ?</h1>", "chr(10) || chr(10) || '# \\1' || chr(10) || chr(10)"),
    ("(?i)<a href=\"([^\"]*)\"> ?(.*?) ?</a>", "'[\\2](\\1)'"), ("(?i)<b> ?(.*?) ?</b>", "'**\\1**'"), ("(?i)<li> ?", "chr(10) || '- '"), ("(?i)<br>", "chr(10)"), ("(?i)</?(p|div|ul|section|main)(>|\\s[^>]*>)", "chr(10) || chr(10)"), ("<[^>]*>", "''"))} as flow
  from heads
), named as (
  select *, replace(replace(replace(replace(replace(replace(flow, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&amp;', '&') as plain from flowed
), tidied as (
  select *, trim({_replaced("trim(plain, ' ' || chr(10) || chr(9))", ("[ \\t]+\\n", "chr(10)"), ("\\n[ \\t]+", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"))}, ' ' || chr(10)) as tidy from named
), articles as (
  select page_id, html, case when title = '' or starts_with(tidy, '# ') then tidy else '# ' || title || chr(10) || chr(10) || tidy end as markdown from tidied
)"""

_LINK = r"""parts as (
  select page_id, url, regexp_extract(url, '#.*$') as fragment, regexp_replace(url, '#.*$', '') as bare, regexp_extract(url, '^[a-z]+') as scheme,
    case when page_id % 2 = 0 then regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) else 'other.example' end as host
  from pages
), queried as (
  select *, case when strpos(bare, '?') > 0 then string_split(bare, '?')[-1] else '' end as query, string_split(bare, '?')[1] as path, scheme || '://' || host as own from parts
), cleaned as (
  select *, case when regexp_matches(query, '(^|&)(utm_[^=&]*|fbclid|gclid|ref_src)(=|&|$)')
    then array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=&]*|fbclid|gclid|ref_src)(=|$)'))), '&') else query end as rest,
    case when path = own then '/' when starts_with(path, own || '/') then substr(path, length(own) + 1) else path end as local
  from queried
)"""

SQL = {
    "log_summary": f"with {_SUMMARY} select * from summary",
    "log_error_lines": f"with {_LOGS} select * from lines where {_ERROR}",
    "log_documents": f"with {_SUMMARY} select user_id, string_agg(line, chr(10) order by line_no) as markdown, ((length(string_agg(line, chr(10) order by line_no)) + 3) // 4)::bigint as n_tokens from summary group by user_id",
    "est_tokens": f"select doc_id, {_CEIL4.format('text')} as n_tokens from documents",
    "clean_text": r"""
with raw as (select doc_id, ' ' || chr(13) || chr(10) || text || '  ' || repeat(chr(13) || chr(10), 4) || 'end ' || chr(9) as t from documents)
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') as cleaned
from raw""",
    "human_units": f"select doc_id, {_count('n_chars')} as tokens, {_bytes('n_chars', [' B', ' KB', ' MB', ' GB'])} as bytes, {_bytes('n_chars', ['B', ' K', ' M'])} as size from documents",
    "detect_kind": r"""
with every as (
  select 'page ' || page_id as id, html as text, null as path, case when page_id % 5 = 0 then 'text/html' end as media from pages
  union all select 'document ' || doc_id, text, case when doc_id % 7 = 0 then 'notes.log' end, null from documents
  union all select 'event ' || event_id, props, null, null from events
), headed as (
  select *, lower(regexp_replace(substr(text, 1, 2048), '^[ \t\r\n]+', '')) as head, regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as whole from every
)
select id, case when starts_with(text, '%PDF-') then 'pdf' when media = 'text/html' then 'html' when path like '%.log' then 'logfile'
  when starts_with(head, '<!doctype html') or starts_with(head, '<html') or contains(head, '<head') or contains(head, '<body') then 'html'
  when (starts_with(whole, '{') or starts_with(whole, '[')) and json_valid(whole) then 'json'
  when starts_with(head, 'diff --git ') or (contains(head, '--- a/') and contains(head, '+++ b/')) then 'diff' else 'text' end as kind
from headed""",
    "classify_address": r"""
with paths as (
  select page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) as path from pages
), forms as (
  select page_id, unnest([url, regexp_replace(url, '^https?://', ''), 'localhost:3000' || path, ltrim(path, '/')]) as address, unnest([0, 1, 2, 3])::int as form from paths
)
select page_id, form, case when trim(address) = '' then 'empty' when regexp_matches(address, '^https?://') then 'url' when starts_with(address, 'file:') then 'file'
  when regexp_matches(address, '^(localhost|127\.0\.0\.1|\[::1\])(:[0-9]+)?(/|$)') then 'local' when regexp_matches(address, '^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(:[0-9]+)?(/|$)') then 'host' else 'path' end as address_kind
from forms""",
    "pr_diff_url": r"""
with forms as (
  select page_id, unnest([url, 'https://github.com/a/b/pull/' || page_id, 'https://github.com/a/b/pull/' || page_id || '/', 'https://github.com/a/b/commit/' || md5(url), 'https://github.com/a/b/pull/' || page_id || '/files']) as address, unnest([0, 1, 2, 3, 4])::int as form from pages
)
select page_id, form, case when regexp_matches(address, '^https://github\.com/[\w.-]+/[\w.-]+/(pull/[0-9]+|commit/[0-9a-fA-F]{7,40})/?$') then rtrim(address, '/') || '.diff' else address end as address from forms""",
    "decode_text": r"select doc_id, md5(case when doc_id % 3 = 1 then regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') else text end) as digest, true as is_text from documents",
    "text_test": "select doc_id, doc_id % 5 not in (2, 4) as is_text, case when doc_id % 5 = 0 then 'json' else 'text' end as kind from documents where length(text) between 1 and 4000",
    "decode_charsets": f"""
with made as (
  select doc_id, case when doc_id % 4 = 1 then '<meta content="text/html; charset=' || {_sample(lambda k: SAMPLES[k][0].upper())} || '">' else '' end as page, regexp_replace(text, '[^\\x{{00}}-\\x{{7F}}]', '?', 'g') as rest,
    case when doc_id % 4 < 2 then {_sample(_as_named)} else {_sample(lambda k: _as_windows(SAMPLES[k][1].encode(SAMPLES[k][2])))} end as held from documents
)
select doc_id, substr(page || held || rest, 1, 80) as head, md5(page || held || rest) as digest from made""",
    "unescape_intraword": r"""
with words as (select doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z0-9]+', ' ', 'g')) as word from documents where text is not null)
select doc_id, array_to_string([replace(word, ' ', '_'), '`' || replace(word, ' ', '\_') || '` a_b ``c\_d` e\_f`` \`g_h\` \\_i ` j_k', '```x', replace(word, ' ', '\_'), '````', 'é_1 \_x x\_ a\_\_b *a_b*', ' ~~~', 'l\_m', '~~~ no', 'n\_o'], chr(10)) as markdown from words""",
    "text_units": f"""
select doc_id, case when n_chars < 1000 then n_chars::varchar when n_chars >= 10000 then round_even(n_chars / 1000.0, 0)::bigint || 'k' else {_tenths('n_chars', 1000)} || 'k' end as tokens,
  case when length(text) > 40 then substr(text, 1, 40) || '…' else text end as clipped, '  \\# ' || string_split(text, chr(10))[1] as escaped, case when n_chars % 2 = 1 then 'one' else 'many' end as plural from documents""",
    "cache_key": "select event_id, '/data/' || event_id || ':' || epoch_us(ts) || ':' || length(props) as cache_key from events",
    "outline_headings": f"with {_MARKDOWN} select conv_id, id, level, title, n_tokens from sized",
    "outline_format": f"""with {_MARKDOWN}, lined as (
  select conv_id, id, total, repeat('  ', (level - min(level) over (partition by conv_id))::int) || id || '. ' || title || ' (~' || {_count('n_tokens')} || ')' as line from sized
), body as (
  select conv_id, ((any_value(total) + 3) // 4)::bigint as total, count(*) as n, string_agg(line, chr(10) order by id) as body from lined group by conv_id
)
select conv_id, n || ' headings, about ' || {_count('total')} || ' tokens; ask for section=<id>' || chr(10) || body as outline from body""",
    "section_lookup": f"""with {_MARKDOWN}, asked as (
  select s.*, wanted, case when id::varchar = wanted then 1 when lower(title) = wanted then 2 when starts_with(lower(title), wanted) then 3 when contains(lower(title), wanted) then 4 end as rank
  from sized s, (values ('2'), ('turn 1'), ('assistant')) w(wanted)
), best as (
  select *, row_number() over (partition by conv_id, wanted order by rank, id) as place from asked where rank is not null
)
select conv_id, wanted, id, title, regexp_replace(substr(md, (start + 1)::int, (stop - start)::int), '^[ \\n]+|[ \\n]+$', '', 'g') as section from best where place = 1""",
    "page_clamp": "select doc_id, case when n_chars * 100 < 1 then 20000 else least(greatest(n_chars * 100, 500), 500000) end::bigint as budget from documents",
    "json_select_field": f"with {_DOCS} select id, to_json(list_transform(items, lambda x: x.part))::varchar as js from docs",
    "json_select_index": f"with {_DOCS} select id, items[-1].part as last_part, items[3].part::varchar as third_part from docs",
    "json_select_slice": f"with {_DOCS} select id, to_json(items[2:3])::varchar as js from docs",
    "json_select_pick": f"with {_DOCS} select id, to_json(list_transform(items, lambda x: {{'line': x.n, 'part_key': x.part}}))::varchar as js from docs",
    "json_select_multi": f"with {_DOCS} select id, to_json({{'id': id, 'parts': list_transform(items, lambda x: x.part), 'owner': owner.key}})::varchar as js from docs",
    "json_drop_keys": f"with {_DOCS} select id, to_json({{'id': id, 'status': status, 'owner': {{'key': owner.key}}, 'items': list_transform(items, lambda x: {{'n': x.n, 'qty': x.qty}})}})::varchar as js from docs",
    "json_drop_empty": f"with {_ENTRIES} select c_custkey, array_to_string(list_transform(list_filter(entries, lambda e: e.v is not null and e.v <> ''), lambda e: e.k || '=' || e.v), ',') as kept from entries",
    "json_max_items": f"with {_DOCS} select id, array_to_string(list_transform(items[1:3], lambda x: x.part::varchar), ',') || case when len(items) > 3 then ',… ' || (len(items) - 3) || ' more items' else '' end as kept from docs",
    "json_drop_lists": f"with {_DOCS} select id, case when len(items) > 4 then '\"[' || len(items) || ' items omitted]\"' else to_json(list_transform(items, lambda x: x.part))::varchar end as js from docs",
    "json_max_str": "select p_partkey, case when length(p_name) > 6 then substr(p_name, 1, 6) || '…(+' || (length(p_name) - 6) || ' chars)' else p_name end as name from part",
    "json_table": f"with {_DOCS} select id, '| n | part | qty |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string(list_transform(items, lambda x: '| ' || x.n || ' | ' || x.part || ' | ' || x.qty || ' |'), chr(10)) as markdown from docs",
    "json_flatten": f'with {_DOCS} select id, status, owner.key as "owner.key", owner.priority as "owner.priority" from docs',
    "json_ndjson_union": "select user_id, block, '[' || string_agg(props, ',' order by event_id) || ']' as js from (select *, ((row_number() over (partition by user_id order by event_id) - 1) // 500)::int as block from events) group by user_id, block",
    "json_corpus_shape": f"""with {_DOCS}, one as (select * from docs order by id limit 1), least as (select min(len(items)) as low, max(len(items)) as high, count(*) as n from docs), person as (select * from customer order by c_custkey limit 1)
select n + (select count(*) from customer) as n_documents, concat_ws(chr(10), '{{', ' even?: bool (' || (c_custkey % 2 = 0) || ')', ' grid?: [2] [0-2] number (1)', ' id: string|number ("' || replace(left('customer no ' || c_custkey || ' with "quotes" and more', 30), '"', '\\"') || '"…)',
  ' items?: [' || low || case when low = high then '' else '-' || high end || '] {{n: number (' || items[1].n || '), part: number (' || items[1].part || '), qty: number (' || items[1].qty || ')}}',
  ' owner: {{key: number (' || owner.key || '), priority: string ("' || owner.priority || '")}}|null', ' status?: string ("' || status || '")', '}}') as shape from one, least, person""",
    "json_layout": f"""with {_DOCS}, shown as (
  select *, list_transform(items, lambda x: '{{"n":' || x.n || ',"part":' || x.part || ',"qty":' || x.qty || '}}') as parts from docs
), flat as (
  select *, '[' || array_to_string(parts, ',') || ']' as line, array_to_string(parts[1:2] || case when len(parts) > 2 then ['"… ' || (len(parts) - 2) || ' more items"'] else [] end, chr(1)) as few,
    '"id":' || id || ',' || chr(1) || '"status":"' || status || '",' || chr(1) || '"owner":{{"key":' || owner.key || ',"priority":"' || owner.priority || '"}},' || chr(1) || '"items":' as front from shown
), joined as (
  select *, '{{' || replace(front, chr(1), '') || line || '}}' as one, '[' || replace(few, chr(1), ',') || ']' as short from flat
)
select id, case when strlen(one) <= 100 then one else '{{' || {_NL} || ' ' || replace(front, chr(1), {_NL} || ' ') || case when strlen(line) <= 99 then line else '[' || {_NL} || '  ' || array_to_string(parts, ',' || {_NL} || '  ') || {_NL} || ' ]' end || {_NL} || '}}' end as laid,
  case when strlen(short) <= 60 then short else '[' || {_NL} || ' ' || replace(few, chr(1), ',' || {_NL} || ' ') || {_NL} || ']' end as items from joined""",
    "json_shrink": f"""with {_DOCS}, shown as (
  select *, list_transform(items, lambda x: '{{"n":' || x.n || ',"part":' || x.part || ',"qty":' || x.qty || '}}') as parts from docs
)
select id, '{{"id":' || id || ',"status":"' || status || '","owner":{{"key":' || owner.key || '}},"items":[' || array_to_string(parts[1:2], ',') || case when len(parts) > 2 then ',"… ' || (len(parts) - 2) || ' more items"' else '' end || ']}}' as js,
  '{{"id":' || id || ',"status":"' || status || '","items":' || case when len(parts) > 3 then '"[' || len(parts) || ' items omitted]"' else '[' || array_to_string(parts, ',') || ']' end || '}}' as brief from shown""",
    "json_shrink_nested": """
with cut as (select c_custkey, c_name, c_mktsegment, case when length(c_name) > 5 then substr(c_name, 1, 5) || '…(+' || (length(c_name) - 5) || ' chars)' else c_name end as name, case when length(c_mktsegment) > 5 then substr(c_mktsegment, 1, 5) || '…(+' || (length(c_mktsegment) - 5) || ' chars)' else c_mktsegment end as segment from customer)
select c_custkey, '{"key":' || c_custkey || case when c_custkey % 2 = 0 then '' else ',"name":"' || name || '"' end || ',"tags":["' || segment || '","x"]}' as js,
  '{"key":' || c_custkey || ',"void":{"a":null,"c":{"b":""}},"none":["",null]}' as kept from cut""",
    "json_outline": f"""with {_DOCS}, ends as (select *, items[1] as x from docs)
select id, '{{' || {_NL} || ' id: number (' || id || ')' || {_NL} || ' status: string ("' || status || '")' || {_NL} || ' owner: {{key: number (' || owner.key || '), priority: string ("' || owner.priority || '")}}' || {_NL}
  || ' items: [' || len(items) || '] {{n: number (' || x.n || '), part: number (' || x.part || '), qty: number (' || x.qty || ')}}' || {_NL} || '}}' as shape from ends""",
    "json_full_table": f"with {_DOCS} select id, '| n | part | qty |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string(list_transform(items, lambda x: '| ' || x.n || ' | ' || x.part || ' | ' || x.qty || ' |'), chr(10)) || chr(10) || 'order ' || id as markdown from docs",
    "json_records": r"""
with placed as (select o_custkey, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place from orders),
blocked as (select *, place // 1000 as block, place % 1000 as n from placed)
select o_custkey, block::int as block, n::int as n, case when o_orderkey % 13 <> 0 then o_orderkey::varchar end as key, case when o_orderkey % 13 <> 0 then 'a "b" }{ [ \ ' || o_orderpriority end as note,
  case when o_orderkey % 13 = 0 then 'does not fit the schema' end as error from blocked
union all select o_custkey, block::int, count(*)::int, null, null, 'invalid JSON' from blocked where o_custkey % 7 = 0 group by o_custkey, block""",
    "json_rendered": f"""with {_DOCS} select id, 'id: ' || id || {_NL} || 'status: ' || status || {_NL} || 'owner: {{"key":' || owner.key || ',"priority":"' || owner.priority || '"}}' || {_NL} || {_NL} || 'items:' || {_NL} || '| n | part | qty |' || {_NL} || '|---|---|---|' || {_NL}
  || array_to_string(list_transform(items, lambda x: '| ' || x.n || ' | ' || x.part || ' | ' || x.qty || ' |'), {_NL}) as shown, '{{"key":' || owner.key || ',"priority":"' || owner.priority || '"}}' as owner from docs""",
    "json_select_run": f"with {_DOCS} select id, list_transform(items, lambda x: x.part)[2]::varchar as second_part from docs",
    "json_select_steps": f"""with {_DOCS}, shown as (
  select id, list_transform(items, lambda x: x.part) as names, list_transform(items, lambda x: x.qty) as qtys, list_transform(list_filter(items, lambda x: x.n % 3 > 0), lambda x: [x.n::bigint, x.qty::bigint]) as tags, items[1].n % 3 > 0 as tagged from docs
), texts as (
  select *, list_transform(tags, lambda x: '[' || x[1] || ',' || x[2] || ']') as pairs from shown
)
select id, '[' || coalesce(names[2]::varchar, 'null') || ']' as second_name, '[[' || array_to_string(list_transform(tags, lambda x: x[1]), ',') || ']]' as first_tags, '[' || coalesce(pairs[1], 'null') || ']' as tags_of_first, '[' || qtys[-1] || ']' as last_qty, '[[' || array_to_string(qtys[1:2], ',') || ']]' as two,
  '[{{"who":' || names[1] || ',"first":' || case when tagged then tags[1][1]::varchar else 'null' end || '}}]' as picked, '[[' || array_to_string(qtys, ',') || ']]' as picks, '[[' || array_to_string(list_transform(tags, lambda x: x[2]), ',') || ']]' as ends from texts""",
    "json_no_match": f"with {_DOCS} select id, case when len(items) < 5 then 'nothing matches items[4].n; it is an array of ' || len(items) || ' items' end as why, 'nothing matches x; it has the keys id, status, owner, items' as keys from docs",
    "json_first_match": "select c_custkey, c_name as name, c_mktsegment as segment, null::varchar as other from customer",
    "json_union_columns": "select r_regionkey::bigint as id, r_name as name, null::varchar as label, null::varchar as parent from region union all select n_nationkey::bigint, null, n_name, n_regionkey::varchar from nation",
    "json_shape": f"""with {_ENTRIES}, rows as (
  select c_custkey as doc, unnest(list_append(entries, {{'k': 'key', 'v': c_custkey::varchar}})) as e from entries
), kinds as (
  select doc, e.k as key, case when e.v is null then 'null' when e.k = 'key' then 'number' else 'string' end as kind from rows where e.v is null or e.v <> ''
)
select key, (select count(*) from customer)::bigint as n_objects, count(*)::bigint as n_present, count(*) filter (kind = 'null')::bigint as n_null,
  string_agg(distinct kind, '|' order by kind) as kinds, count(*) < (select count(*) from customer) as optional from kinds group by key""",
    "diff_stats": f"""with {_DIFFS}
select conv_id, '1' as file_no, n as adds, n as dels from files union all select conv_id, '2', 1, 0 from files union all select conv_id, 'all', n + 1, n from files""",
    "diff_files": f"""with {_DIFFS}
select conv_id, 1::bigint as file_no, 'c' || conv_id || '.txt' as old_path, 'c' || conv_id || '.txt' as new_path, 'modified' as status, n as adds, n as dels from files
union all select conv_id, 2, null, 'new-c' || conv_id || '.txt', 'new', 1, 0 from files""",
    "diff_heads": f"""with names as (select c_custkey, 'dir b/c' || c_custkey as name from customer)
select c_custkey, '**5 file(s) changed** (+0 -0)' || {_NL} || {_NL} || '## ' || name || ' → moved/' || name || ' (renamed, +0 -0)' || {_NL} || {_NL} || '## ' || name || ' (mode changed, +0 -0)' || {_NL} || {_NL} || '## ' || name || ' (new, +0 -0)' || {_NL} || {_NL}
  || '## ' || name || ' (deleted, +0 -0)' || {_NL} || {_NL} || '## ' || name || ' (binary, +0 -0)' as markdown, name as moved_from from names""",
    "diff_ws_only": f"with {_DIFFS} select conv_id, 1::bigint as file_no, hunk_no::bigint as hunk_no, ws_only from hunks union all select conv_id, 2, 1, false from files",
    "diff_markdown": f"with {_DIFFS} select conv_id, markdown from diffs",
    "pdf_scanned_pages": r"""
with cut as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents
), texts as (
  select doc_id, (line_no - 1) // 2 as page_no, bool_or(regexp_matches(line, '[^ \t\n\x0B\f\r]')) as full from cut group by all
) select doc_id, count(*)::bigint as n_pages, count(*) filter (not "full")::bigint as n_scanned from texts group by doc_id""".replace("as full from", 'as "full" from'),
    "numbering": """
with instances as (
  select n_nationkey as doc, i as num_id, (n_nationkey + i) % 4 as abstract_id from nation, range(6) t(i)
), levels as (
  select n_nationkey as doc, a as abstract_id, l as ilvl, case when (a + l) % 2 = 0 then 'decimal' else 'bullet' end as format from nation, range(4) t(a), range(2) u(l)
)
select c_custkey as paragraph, format from customer left join (select i.doc, num_id, ilvl, format from instances i join levels l on i.doc = l.doc and i.abstract_id = l.abstract_id) f
  on c_nationkey = f.doc and c_custkey % 7 = f.num_id and c_custkey % 3 = f.ilvl""",
    "rel_targets": r"""
with parts as (
  select page_id, list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*/*([^?#]*)', 1), '[^/]*$', ''), '/'), lambda x: x <> '') as folder from pages
), forms as (
  select page_id, 0 as form, list_concat(folder[:-2], ['img', 'a.png']) as path from parts union all select page_id, 1, list_append(folder, 'b.html') from parts union all select page_id, 2, ['root', 'c.css'] from parts
  union all select page_id, 3, list_append(folder, 'd') from parts union all select page_id, 4, list_append(folder[:greatest(len(folder) - 3, 0)], 'e') from parts
) select page_id, form::int as form, array_to_string(path, '/') as path from forms""".replace("list_concat(folder[:-2],", "list_concat(folder[:greatest(len(folder) - 1, 0)],"),
    "tree_ignored": f"""with {_SITE}
select root, path from files where not case when regexp_matches(path, '^de/1[^/]*(/.*)?$') then true when regexp_matches(path, '(^|/)en/.+$') then true
  when regexp_matches(path, '(^|/)8[^/]*[.]html(/.*)?$') then false when regexp_matches(path, '(^|/)[^/]*[.]html(/.*)?$') then true else false end""",
    "tree_rules": f"""with {_SITE}, ruled as (
  select root, path, length(root) % 4 as which, parts[depth] as name, array_to_string(parts[1:depth], '/') as step, depth < len(parts) as is_dir from steps
), judged as (
  select root, path, case which
    when 0 then case when step = 'en/keep.html' then false when is_dir and name = 'en' then true when regexp_matches(name, '^8.*[.]html$') then false else regexp_matches(name, '[.]html$') end
    when 1 then name = 'fr' or regexp_matches(name, '^2.[.]html$') or regexp_matches(step, '^de/1[^/]*$')
    when 2 then case when step = 'en' and is_dir then false when regexp_matches(name, '^[0-4].*[.]html$') then true when step = 'es/7.html' then false else starts_with(step, 'es/') end
    else false end as gone from ruled
)
select root, path from judged group by all having not bool_or(gone)""",
    "tree_summary": f"""with {_SITE}, places as (
  select root, array_to_string(parts[1:depth], '/') as path, parts[1:depth] as steps, depth, max(depth < len(parts)) as is_dir, max(case when depth = len(parts) then bytes end) as shown_size from (select root, path, parts, depth, s.bytes from steps join (select root as r, path as p, size as bytes from files) s on root = s.r and path = s.p) group by all
), counts as (
  select root, array_to_string(steps[1:depth - 1], '/') as path, count(*) as n from places where depth > 1 group by all having count(*) > 100
), shown as (
  select p.*, c.n from places p left join counts c on p.root = c.root and p.path = c.path
  where not exists (select 1 from counts a where a.root = p.root and starts_with(p.path, a.path || '/'))
), lined as (
  select root, is_dir, array_to_string(list_transform(steps, lambda x, i: case when i < depth or is_dir then '0' else '1' end || x), chr(1)) as place,
    repeat('  ', depth) || case when is_dir then steps[-1] || '/' || case when n is not null then ' (' || n || ' items, collapsed)' else '' end else steps[-1] || ' (' || {_bytes('shown_size', [' B', ' KB', ' MB', ' GB'])} || ')' end as line from shown
)
select root, '**' || count(*) filter (not is_dir) || case when count(*) filter (not is_dir) = 1 then ' file, ' else ' files, ' end || count(*) filter (is_dir) || case when count(*) filter (is_dir) = 1 then ' directory**' else ' directories**' end
  || {_NL} || {_NL} || '```' || {_NL} || root || '/' || {_NL} || string_agg(line, {_NL} order by place) || {_NL} || '```' as markdown from lined group by root""",
    "pdf_running_lines": f"with {_PAGED} select * from repeated",
    "pdf_page_numbers": f"with {_PAGED} select doc_id, page_no, value from valued",
    "pdf_offset_mode": f"with {_PAGED} select * from best",
    "pdf_clean_lines": f"""with {_PAGED}, gone as (
  select doc_id, page_no, line_no from edges join repeated using (doc_id, key) union select doc_id, page_no, line_no from valued v join best using (doc_id) where v.value - v.page_no = best.page_offset
)
select doc_id, count(*)::bigint as n_lines from paged p where not exists (select 1 from gone g where g.doc_id = p.doc_id and g.page_no = p.page_no and g.line_no = p.line_no) group by doc_id""",
    "grid_trim": f"with {_GRID} select sheet, row_no::bigint as row_no, name || '|' || number as cells from grid",
    "markdown_table": f"""with {_GRID}, lined as (
  select sheet, row_no, '| ' || name || ' | ' || number || ' |' || case when row_no = min(row_no) over (partition by sheet) then chr(10) || '|---|---|' else '' end as line from grid
) select sheet, string_agg(line, chr(10) order by row_no) as markdown from lined group by sheet""",
    "style_chain": f"{_STYLES} select style_id, hop, ancestor from chain",
    "style_inherited": f"{_STYLES} select c.style_id, arg_min(s.font, hop) as font from chain c join styles s on c.ancestor = s.style_id where s.font is not null group by c.style_id",
    "slide_join": "select n_regionkey as doc, n_name as position, 'slide' || n_nationkey as target, case when n_nationkey % 2 = 0 then 'notes' || n_nationkey end as notes from nation",
    "rel_lookup": "select page_id % 10 as doc, page_id as span_no, 'link ' || page_id as text, case when page_id % 3 <> 0 then url end as url from pages",
    "tree_counts": f"""with {_SITE}
select root, parent, count(*) filter (not is_dir)::bigint as n_files, count(*) filter (is_dir)::bigint as n_dirs, case when count(*) > 100 and parent <> '' then 'crowded' end as collapsed from entries group by root, parent""",
    "html_title": r"select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title from pages",
    "html_links": """
with found as (select page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) as hrefs from pages)
select page_id, generate_subscripts(hrefs, 1)::int - 1 as n, unnest(hrefs) as href from found""",
    "html_link_rewrite": f"with {_LINK} select page_id, local || case when rest <> '' then '?' || rest else '' end || fragment as link from cleaned",
    "html_strip": f"select page_id, {_stripped()} as text from pages",
    "html_markdown": f"with {_PAGES} select page_id, markdown from articles",
    "html_pruned": """
select page_id, 'T ' || page_id as title, case when page_id % 2 = 1 then 'inner a b c d e f outer' else regexp_replace('page ' || page_id || ' of ' || regexp_extract(url, '([a-z0-9]+)[.]?[a-z]*$', 1) || ' end', ' +', ' ', 'g') end as text from pages""",
    "html_summary": f"""
select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1))::int as n_links,
  length({_stripped()})::int as n_chars, strlen({_stripped()}) < 300 and contains(lower(html), '<script') as needs_js from pages""",
    "savings_ledger": f"""with {_SUMMARY}, measured as (
  select 'html' as kind, {_CEIL4.format('html')} as raw_tokens, ((length({_stripped()}) + 3) // 4)::bigint as out_tokens from pages
  union all
  select 'log', r.n, s.n from (select user_id, ((sum(length(line) + 1) + 2) // 4)::bigint as n from lines group by user_id) r
    join (select user_id, ((length(string_agg(line, chr(10) order by line_no)) + 3) // 4)::bigint as n from summary group by user_id) s using (user_id)
)
select kind, count(*)::bigint as n, sum(raw_tokens)::bigint as raw_tokens, sum(out_tokens)::bigint as out_tokens,
  case when sum(raw_tokens) > 0 then ((sum(raw_tokens) - sum(out_tokens)) * 100 // sum(raw_tokens))::bigint end as saved_pct from measured group by rollup (kind)""",
    "ab_pivot": """with runs as (
  select conv_id % 10 as task, case when conv_id // 10 % 2 = 0 then 'plain' else 'short' end as arm, length(text)::bigint as tokens, (turn % 2 = 0)::int as correct from conversations
), tasks as (
  select task, count(*) filter (arm = 'plain') as pr, sum(tokens) filter (arm = 'plain') as pt, sum(correct) filter (arm = 'plain') as pc,
    count(*) filter (arm = 'short') as sr, sum(tokens) filter (arm = 'short') as st, sum(correct) filter (arm = 'short') as sc from runs group by task
)
select coalesce(task::varchar, 'all') as task, sum(pr)::bigint as plain_runs, (sum(pt) // sum(pr))::bigint as plain_mean, sum(pc)::bigint as plain_correct, sum(sr)::bigint as short_runs, (sum(st) // sum(sr))::bigint as short_mean, sum(sc)::bigint as short_correct,
  trunc((sum(st) // sum(sr) - sum(pt) // sum(pr)) * 100.0 / (sum(pt) // sum(pr)))::bigint as change_pct
from tasks where pr > 0 and sr > 0 group by rollup (tasks.task)""",
    "session_usage": """with last as (
  select conv_id, turn // 2 as call_id, arg_max({'i': length(text), 'o': length(role)}, turn) as u from conversations group by all
)
select conv_id as session, count(*)::bigint as n_calls, sum(u.i)::bigint as input_total, max(u.i)::bigint as context_end, sum(u.o)::bigint as output_total from last group by conv_id""",
    "grade_answers": r"""with facts(task, phrases) as (values (0, ['the', 'und']), (0, ['of']), (1, ['de', 'in'])), answers as (
  select conv_id * 1000 + turn as answer_id, conv_id % 2 as task, trim(regexp_replace(regexp_replace(lower(text), '[*_`]', '', 'g'), '\s+', ' ', 'g')) as answer from conversations
), hits as (
  select answer_id, len(list_filter(phrases, lambda p: regexp_matches(answer, '(^|[^\pL\pN])' || p || '($|[^\pL\pN])'))) > 0 as hit from answers join facts using (task)
)
select answer_id, count(*)::bigint as n_facts, count(*) filter (not hit)::bigint as n_missing, bool_and(hit) as correct from hits group by answer_id""",
    "error_category": """
select event_id, case when event_id % 7 = 0 then '' else case event_id % 6 when 0 then case when event_id % 4 = 0 then 'not_found' else 'network_error' end
  when 1 then 'timeout' when 2 then 'network_error' when 3 then 'invalid_input' when 4 then 'convert_error' else 'other' end end as category from events""",
    "event_microbatch": "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*)::bigint as n from events group by all",
    "paginate": """with recursive cut as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents
), packed(doc_id, k, line, page_no, used) as (
  select doc_id, k, line, 1, length(line) from cut where k = 1
  union all
  select c.doc_id, c.k, c.line, case when p.used + 1 + length(c.line) <= 500 then p.page_no else p.page_no + 1 end, case when p.used + 1 + length(c.line) <= 500 then p.used + 1 + length(c.line) else length(c.line) end
  from packed p join cut c on c.doc_id = p.doc_id and c.k = p.k + 1
)
select doc_id, page_no::int as page_no, count(*)::int as n_lines, string_agg(line, chr(10) order by k) as content from packed group by doc_id, page_no""",
}
SQL["page_n"] = SQL["paginate"].replace("<= 500", "<= 2000").replace("select doc_id, page_no::int as page_no, count(*)::int as n_lines, string_agg(line, chr(10) order by k) as content from packed", "select doc_id, string_agg(line, chr(10) order by k) as content from packed where page_no = 2")

_LEDGER = SQL["savings_ledger"]
_AB = SQL["ab_pivot"]


def _report(source: str, columns: list[str], order: str) -> str:
    line = " || ' | ' || ".join(f"coalesce({c}::varchar, '')" for c in columns)
    head = "| " + " | ".join(columns) + " |"
    return f"select '{head}' || {_NL} || '|{'---|' * len(columns)}' || {_NL} || string_agg('| ' || {line} || ' |', {_NL} order by {order}) as markdown from ({source})"


#: Documents of all kinds with their Markdown, as the reading queries see them.
_READ = rf"""with {_PAGES}, {_DIFFS}, {_DOCS}, loglines as (
  select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 5000 as block, row_number() over (partition by user_id order by ts, event_id) as line_no,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' event ' || event_id as line from events
), near as (
  select *, max({_ERROR}::int) over (partition by user_id, block order by line_no rows between 2 preceding and 2 following) as kept from loglines
), runs as (
  select *, sum(kept) over (partition by user_id, block order by line_no) as run from near
), summary as (
  select user_id, block, line_no, line from runs where kept = 1
  union all select user_id, block, min(line_no), case when count(*) = 1 then min(line) else '... ' || count(*) || ' lines omitted ...' end from runs where kept = 0 group by user_id, block, run
), cleaned as (
  select doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', {_NL}, 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', {_NL} || {_NL}, 'g'), '^[\t-\r ]+|[\t-\r ]+$', '', 'g') as markdown from documents
), made as (
  select 'page ' || page_id as id, 'html' as kind, markdown, html as raw from articles
  union all select 'document ' || doc_id, 'text', markdown, text from cleaned
  union all select 'log ' || s.user_id || ' ' || s.block, 'logfile', s.markdown, r.raw from (select user_id, block, string_agg(line, {_NL} order by line_no) as markdown from summary group by all) s
    join (select user_id, block, string_agg(line, {_NL} order by line_no) as raw from loglines group by all) r on s.user_id = r.user_id and s.block = r.block
  union all select 'diff ' || conv_id, 'diff', markdown, raw from diffs
  union all select 'order ' || id, 'json', to_json({{'id': id, 'status': status, 'owner': owner, 'items': items}})::varchar, to_json({{'id': id, 'status': status, 'owner': owner, 'items': items}})::varchar from docs
), ready as (
  select id, kind, markdown, raw, case when kind = 'html' and strlen({_STRIPPED.replace("regexp_replace(html,", "regexp_replace(raw,")}) < 300 and contains(lower(raw), '<script') then 'the page builds itself with scripts, little of it is text' end as note from made
)"""
_SECTIONS = r"""cut as (
  select id, length(markdown) as total, markdown, unnest(string_split(markdown, chr(10))) as line, generate_subscripts(string_split(markdown, chr(10)), 1) as line_no from ready where kind <> 'json'
), placed as (
  select *, sum(length(line) + 1) over (partition by id order by line_no) - length(line) - 1 as start from cut
), found as (
  select id as doc, total, line_no, start::bigint as start, length(regexp_extract(line, '^ {0,3}(#{1,6})[ \t]', 1))::int as level, trim(regexp_extract(line, '^ {0,3}#{1,6}[ \t]+(.*?)[ \t#]*$', 1)) as title
  from placed where regexp_matches(line, '^ {0,3}#{1,6}[ \t]+[^ \t#]')
), numbered as (
  select *, row_number() over (partition by doc order by line_no)::int as n from found
), sized as (
  select a.doc, a.n, a.level, a.title, a.start, coalesce(min(b.start), any_value(a.total)) as stop from numbered a left join numbered b on a.doc = b.doc and b.n > a.n and b.level <= a.level group by a.doc, a.n, a.level, a.title, a.start
)"""
SQL |= {
    "read_docs": f"{_READ} select id, kind, markdown, {_CEIL4.format('raw')} as raw_tokens, {_CEIL4.format('markdown')} as out_tokens, note, null::varchar as error from ready",
    "read_outlines": f"""{_READ}, {_SECTIONS}, lined as (
  select doc, n, repeat('  ', (level - min(level) over (partition by doc))::int) || n || '. ' || title || ' (~' || {_count('((stop - start + 3) // 4)::bigint')} || ')' as line from sized
), body as (
  select doc, count(*) as n, string_agg(line, {_NL} order by n) as body from lined group by doc
)
select r.id, case when n is null then 'no headings; about ' || {_count('((length(markdown) + 3) // 4)::bigint')} || ' tokens, ask for page=1' else n || ' headings, about ' || {_count('((length(markdown) + 3) // 4)::bigint')} || ' tokens; ask for section=<id>' || {_NL} || body end as outline
from ready r left join body b on r.id = b.doc where kind <> 'json'
union all select 'order ' || d.id, 'JSON of about ' || ((length(markdown) + 3) // 4) || ' tokens' || {_NL} || '{{' || {_NL} || ' id: number (' || d.id || ')' || {_NL} || ' status: string ("' || status || '")' || {_NL} || ' owner: {{key: number (' || owner.key || '), priority: string ("' || owner.priority || '")}}' || {_NL}
  || ' items: [' || len(items) || '] {{n: number (' || items[1].n || '), part: number (' || items[1].part || '), qty: number (' || items[1].qty || ')}}' || {_NL} || '}}' from docs d join ready r on r.id = 'order ' || d.id""",
    "read_page": f"""{_READ.replace("with ", "with recursive ", 1)}, whole as (
  select id, unnest(string_split(markdown, {_NL})) as line, generate_subscripts(string_split(markdown, {_NL}), 1) as k from ready
), cutting(id, k, j, line, rest) as (
  select id, k, 0, '', line from whole
  union all
  select id, k, j + 1, substr(rest, 1, n), substr(rest, n + case when at_blank then 2 else 1 end) from (
    select *, case when at_blank then blank else 1000 end as n from (
      select *, 1000 - strpos(reverse(substr(rest, 1, 1000)), ' ') as blank, length(rest) > 1000 and strpos(reverse(substr(rest, 1, 1000)), ' ') between 1 and 199 as at_blank from cutting where rest <> '' or j = 0
    )
  )
), pieces as (
  select id, line, row_number() over (partition by id order by k, j) as k from cutting where j > 0
), packed(id, k, line, page_no, used) as (
  select id, k, line, 1, length(line) from pieces where k = 1
  union all
  select c.id, c.k, c.line, case when p.used + 1 + length(c.line) <= 1000 then p.page_no else p.page_no + 1 end, case when p.used + 1 + length(c.line) <= 1000 then p.used + 1 + length(c.line) else length(c.line) end
  from packed p join pieces c on c.id = p.id and c.k = p.k + 1
), counted as (
  select id, max(page_no) as n, string_agg(line, {_NL} order by k) filter (page_no = 2) as content from packed group by id
)
select c.id, content || case when n > 1 then {_NL} || {_NL} || '[page 2 of ' || n || case when n > 2 then ' · next: page=3' else '' end || ']' else '' end || case when note is null then '' else {_NL} || {_NL} || '[note: ' || note || ']' end as content,
  case when content is null then 'page 2 out of range: there are ' || n || ' page(s)' end as error from counted c join ready r on c.id = r.id""",
    "read_json": f"""with {_DOCS} select 'order ' || id as id, 0 as n, '| n | part | qty |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string(list_transform(items, lambda x: '| ' || x.n || ' | ' || x.part || ' | ' || x.qty || ' |'), chr(10)) as content, null::varchar as error from docs
union all select 'page ' || page_id, 0, null, 'not JSON (it looks like html): use read_docs' from pages
union all select 'document ' || doc_id, 0, null, 'invalid JSON' from documents where text is not null
union all select 'log ' || user_id || ' ' || block, 0, null, 'not JSON (it looks like logfile): use read_docs' from (select distinct user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 5000 as block from events)
union all select 'diff ' || conv_id, 0, null, 'not JSON (it looks like diff): use read_docs' from (select distinct conv_id from conversations)""",
    "read_section": f"""with {_DIFFS}, asked as (select conv_id, markdown, wanted from diffs, (values ('2'), ('NEW-c'), ('nothing')) w(wanted))
select 'diff ' || conv_id as id, wanted, case when wanted <> 'nothing' then substr(markdown, strpos(markdown, '## new-c')) end as section, case when wanted = 'nothing' then 'no section matches nothing' end as error from asked
union all select 'order ' || o_orderkey, wanted, null, 'sections are for documents: use read_json' from (select distinct o_orderkey from orders join lineitem on o_orderkey = l_orderkey), (values ('2'), ('NEW-c'), ('nothing')) w(wanted)""",
    "ledger_report": _report(_LEDGER, ["kind", "n", "raw_tokens", "out_tokens", "saved_pct"], "kind nulls last"),
    "ab_report": _report(_AB, ["task", "plain_runs", "plain_mean", "plain_correct", "short_runs", "short_mean", "short_correct", "change_pct"], "task nulls last"),
    "tool_summary": r"""
with labels as (select conv_id, case when role = 'user' then 'Bash(' || regexp_extract(text, '^\s*(\S+)', 1) || ')' else 'read' end as label from conversations), counted as (select conv_id, label, count(*) as n from labels group by all)
select conv_id as session, array_to_string(list_sort(list(label || case when n > 1 then '×' || n else '' end)), ', ') as tools from counted group by conv_id""",
    "sessions": r"""
with turns as (select conv_id as session, turn::bigint as turn, role = 'user' as asks, length(text) as n from conversations), uses as (
  select u.session, case u.turn % 3 when 0 then 'Bash(grep)' when 1 then 'read_it' else 'Edit' end as label, u.n + u.turn + 2 as context, a.n + case when a.turn % 4 < 2 then 0 else 2 end as chars
  from turns u left join turns a on a.session = u.session and a.turn = u.turn + 1 and a.asks where not u.asks
), labels as (select session, label, count(*) as n, sum(chars) as chars from uses group by all), called as (
  select session, count(*) as n_calls, sum(context) as input_total, max(context) as context_end, 3 * count(*) as output_total, count(*) filter (chars is null) as n_unanswered from uses group by session
), tooled as (
  select session, array_to_string(list_sort(list(label || case when n > 1 then '×' || n else '' end)), ', ') as tools, arg_max(label, {'c': chars, 'l': label}) filter (chars > 0) as top_tool from labels group by session
), whole as (select session, count(*) as n, coalesce(sum(case when asks then n + case when turn % 4 < 2 then 0 else 2 end end), 0) as tool_chars from turns group by session)
select w.session, coalesce(n_calls, 0)::bigint as n_calls, coalesce(input_total, 0)::bigint as input_total, coalesce(context_end, 0)::bigint as context_end, coalesce(output_total, 0)::bigint as output_total, coalesce(tools, '') as tools,
  coalesce(n_calls, 0)::bigint as n_tools, coalesce(n_unanswered, 0)::bigint as n_unanswered, tool_chars::bigint as tool_chars, top_tool, 'done' || chr(10) || 'all' as answer, 0.25::double as cost, n::int as turns, 1500::bigint as duration_ms, 1 as denied, least(105, n)::bigint as side_tokens,
  case when w.session % 7 = 0 then 'server files failed' when w.session % 5 = 0 then 'error_max: done' end as error
from whole w left join called c on w.session = c.session left join tooled t on w.session = t.session""",
    "context_sizes": "select conv_id, turn, (length(text) + turn + case when turn % 2 = 0 then length(role) else 0 end)::bigint as input from conversations",
    "side_tokens": "select conv_id as session, (sum(n) - max(n))::bigint as side_tokens from (select conv_id, role, sum(length(text)) as n from conversations group by all) group by conv_id",
    "verdicts": r"select conv_id, turn, case when turn % 5 = 4 then 'error' when length(text) % 2 = 0 then 'yes' else 'no' end as verdict, regexp_extract(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^[^\n]*') as first_line from conversations",
    "error_texts": "select page_id, case length(url) % 3 when 0 then 'HTTP 404 from ' || url when 2 then 'fetch ' || url || ': timed out' end as error from pages",
    "entry_sizes": "select page_id, (strlen(url) + strlen(html))::bigint as size from pages",
    "freshness": "select event_id, event_id % 3 <> 0 and (event_id % 2 = 0 or event_id % 4 > 1 or (event_id % 5 = 0 and event_id % 7 <> 0)) as reuse from events",
    "count_or_time_batches": """with recursive ordered as (
  select user_id, event_id, epoch_us(ts) as moment, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null and ts is not null
), taken as (
  select user_id, event_id, moment, k, moment as first_at, 1 as n from ordered where k = 1
  union all
  select o.user_id, o.event_id, o.moment, o.k, case when t.n = 20 or o.moment - t.first_at >= 21600000000 then o.moment else t.first_at end, case when t.n = 20 or o.moment - t.first_at >= 21600000000 then 1 else t.n + 1 end
  from taken t join ordered o on o.user_id = t.user_id and o.k = t.k + 1
), numbered as (
  select *, sum(case when n = 1 then 1 else 0 end) over (partition by user_id order by k) as batch from taken
)
select user_id, min(first_at)::bigint as first_at, count(*)::bigint as n, arg_min(event_id, k)::bigint as first_event, arg_max(event_id, k)::bigint as last_event from numbered group by user_id, batch""",
    "ttl_cache": """with recursive ordered as (
  select user_id, epoch_us(ts) as moment, row_number() over (partition by user_id order by ts, event_id) as k from events
), walk(user_id, k, inserted, hits) as (
  select user_id, k, moment, 0 from ordered where k = 1
  union all
  select o.user_id, o.k, case when o.moment - w.inserted <= 86400000000 then w.inserted else o.moment end, w.hits + (o.moment - w.inserted <= 86400000000)::int from walk w join ordered o on o.user_id = w.user_id and o.k = w.k + 1
)
select user_id, max(k)::bigint as n_reads, max(hits)::bigint as n_hits from walk group by user_id""",
}
