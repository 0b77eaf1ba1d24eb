"""SQL for DuckDB that gives the rows of the queries it can express."""

from __future__ import annotations

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIXING = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, coalesce(md5(text), 'null') as mark from documents
), ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from sizes group by source
), weighted as (
  select source, source_size, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 2.0::double as cap from ranked
), leveled as (
  select *, row_number() over w as place,
    (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))
      / (sum(weight) over () - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0)) as level
  from weighted window w as (order by cap / weight, source nulls last)
), final as (
  select arg_min(level, place) as level from leveled where level * weight < cap
), targets as (
  select source, source_size, case when final.level is null then cap else least(cap, final.level * weight) end as target from leveled, final
), rated as (
  select doc_id, mark, size, source_size, target, case when source_size > 0 then least(target / source_size, 2.0) else 0.0 end as rate
  from sizes join targets on sizes.source is not distinct from targets.source
)
select doc_id, size, source_size, target::double as target,
  size * (floor(rate) + case when ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null') || '|' || mark), 1, 13))::bigint / 4503599627370496.0 < rate - floor(rate) then 1 else 0 end)::bigint as taken
from rated
"""

URLS = f"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_CAPITALS}', '{_SMALL}') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from parts
), rules(rule_host, rule_path, rule_verdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits as (
  select page_id, host, path, rule_host || rule_path as rule, rule_verdict,
    row_number() over (partition by page_id, host, path order by length(rule_host || rule_path) desc nulls last, length(rule_host) desc) as place
  from (select distinct page_id, host, path from split)
  left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.rule_verdict, 'allow') as verdict
from split s join fits f on s.page_id is not distinct from f.page_id and s.host = f.host and s.path = f.path where f.place = 1
"""
