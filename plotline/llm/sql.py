"""DuckDB twins of the numbered operators that SQL can express."""

from __future__ import annotations

import string

from plotline.llm import sharding

_WORDS = (f"regexp_extract_all(translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

DECONTAMINATION = f"""
with docs as (select doc_id, row_number() over () as r, {_WORDS.format("coalesce(text, '')")} as w from documents),
items as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS.format('text')} as w from benchmark),
sized as (select item, w, least(10, len(w)) as size from items where len(w) > 0),
starts as (select item, w, size, unnest(range(1, len(w) - size + 2)) as s from sized),
windows as (select distinct item, size, array_to_string(w[s:s + size - 1], ' ') as win from starts),
sizes as (select distinct size from windows),
places as (select r, size, unnest(range(1, len(w) - size + 2)) as s from docs, sizes where len(w) >= size),
found as (select p.r, p.s, p.size, x.item from places p join docs d on p.r = d.r
          join windows x on x.size = p.size and x.win = array_to_string(d.w[p.s:p.s + p.size - 1], ' ')),
hit_places as (select r, unnest(range(s, s + size)) as pos from found),
hits as (select r, count(distinct pos) as n_hit from hit_places group by r),
which as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from found group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(i.n_items, 0) as bigint) as n_items, sha256(coalesce(i.ids, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hits h on d.r = h.r left join which i on d.r = i.r"""

ORACLES: dict[str, str] = {"op4_sharding": sharding.oracle(), "op8_decontamination": DECONTAMINATION}
