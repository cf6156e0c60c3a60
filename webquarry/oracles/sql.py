"""Pieces of SQL for the checking engine, written on their own rather than from the Spark plans."""

from __future__ import annotations

from webquarry.functions import patterns as P
from webquarry.functions.text import ENTITIES


#: A tag and a token, as a plain pattern that may back off.
TAG = r"""<[a-zA-Z/!?][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
TOKEN = rf"(?s){TAG}|[^<]+|<"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rep(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    to = to if to.startswith("chr(") else q(to)
    return f"regexp_replace({x}, {q(pattern)}, {to}, '{flags}')"


def trim(x: str) -> str:
    return rep(x, P.EDGE_WS)


def collapse(x: str) -> str:
    return f"trim({rep(x, P.PLAIN_WS_RUN, ' ')})"


def decode(x: str) -> str:
    for ref, char in ENTITIES.items():
        x = f"replace({x}, {q(ref)}, {q(char)})"
    return x


def attr(tok: str, name: str) -> str:
    """Attribute in double quotes, the only form the tables hold; null when absent."""
    return f"nullif(regexp_extract({tok}, {q(rf'(?is)[\s]{name}=\"([^\"]*)\"')}, 1), '')"


WORDS = f"len(regexp_extract_all(%s, {q(P.NON_WS)}))"


def words(x: str) -> str:
    return WORDS % x


def visible(html: str = "html") -> str:
    return rep(html, P.HIDDEN)


def tokens_cte(pages: str = "pages", name: str = "tok") -> str:
    return f"""
{name}_a as (select page_id, list_append(regexp_extract_all({visible()}, {q(TOKEN)}), '</#end>') a from {pages}),
{name}_b as (select page_id, unnest(a) tok, generate_subscripts(a, 1) - 1 pos from {name}_a),
{name} as (select page_id, pos, tok,
  case when tok = '</#end>' then '#end' else lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) end tag,
  case when tok = '</#end>' then 'close' when not regexp_matches(tok, '(?s)^<[a-zA-Z/!?].*>$') then 'text'
       when regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1) = '' then 'other'
       when tok like '</%' then 'close'
       when lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) in
            ('area','base','br','col','embed','frame','hr','img','input','link','meta','param','source','track','wbr') then 'void'
       else 'open' end kind
  from {name}_b)"""


def elements_cte(tok: str = "tok", name: str = "el") -> str:
    """Extents by pairing; contents are then found by interval joins."""
    blocks = "('p','div','ul','ol','h1','h2','h3','h4','h5','h6','section','article','table','footer','header','nav','blockquote','pre','form','hr')"
    inline = "('b','i','a','em','strong','span','u')"
    boxes = "('ul','ol','table','tbody','thead','tr','select','dl','#end')"
    sibs = "('li','td','th','tr','option','dt','dd')"
    return f"""
{name}_l as (select *, sum(case kind when 'open' then 1 when 'close' then -1 else 0 end)
     over (partition by page_id, tag order by pos) + (case when kind = 'close' then 1 else 0 end) lvl
  from {tok} where kind in ('open','close','void')),
{name}_p as (select *,
    lead(pos) over wl mate_pos, lead(kind) over wl mate_kind,
    lead(pos) over wt twin_pos, lead(kind) over wt twin_kind,
    min(case when (kind in ('open','void') and tag in {blocks}) or (kind = 'close' and tag not in {inline}) then pos end) over wf next_block,
    min(case when kind = 'close' and tag in {boxes} then pos end) over wf next_box,
    max(pos) over (partition by page_id) page_end
  from {name}_l
  window wl as (partition by page_id, tag, lvl order by pos), wt as (partition by page_id, tag order by pos),
         wf as (partition by page_id order by pos rows between 1 following and unbounded following)),
{name} as (select page_id, pos, tag, kind, tok, coalesce(kind = 'open' and mate_kind = 'close', false) closed,
    case when kind = 'void' then pos when mate_kind = 'close' then mate_pos
         when tag in ('html','body') then page_end
         when tag in {sibs} then (case when twin_kind = 'open' and twin_pos < next_box then twin_pos else next_box end)
         else next_block end stop
  from {name}_p where kind <> 'close')"""


def noise_cte(el: str = "el", tok: str = "tok", name: str = "kept") -> str:
    """Tokens outside every noise element, by an anti join on intervals."""
    cls, ident, role = attr("tok", "class"), attr("tok", "id"), attr("tok", "role")
    return f"""
noise as (select page_id, pos, tag, case when kind = 'void' then pos when closed then stop else stop - 1 end last from {el}
  where tag in ('script','style','noscript','nav','footer','header') or {cls} like '%ad%' or {ident} like '%ad%'
     or {role} in ('banner','navigation','complementary','contentinfo')
     or {cls} in ('social-share','share-buttons','social-media','sidebar','related-posts','related-articles','newsletter','subscribe')),
{name} as (select t.* from {tok} t where t.tag <> '#end' and not exists
  (select 1 from noise n where n.page_id = t.page_id and t.pos between n.pos and n.last))"""
