"""DuckDB SQL for the registered queries, written from the definitions of the results."""

from __future__ import annotations

BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm(x: str) -> str:
    """Normalised text: lower, strip, drop artefacts, fold blanks, currency, thousands."""
    stripped = f"regexp_replace(lower(coalesce({x},'')), '^{BLANKS}|{BLANKS}$', '', 'g')"
    artefacts = rf"regexp_replace({stripped}, '\^?\{{\}}?\[?\]?', '', 'g')"
    blanks = f"regexp_replace({artefacts}, '{BLANKS}', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({blanks}, '[$€£¥]', '', 'g'), ',(\p{{Nd}}{{3}})', '\1', 'g')"


def round3(x: str) -> str:
    return f"cast(format('{{:.3f}}', {x}) as double)"


def money(x: str) -> str:
    return f"cast(cast({x} as decimal(18,2)) as varchar)"


def sep(x: str) -> str:
    return (
        f"case when {x} >= 1000 then concat(cast(cast(floor({x}/1000) as bigint) as varchar), ',', "
        f"right({money(x)}, 6)) else {money(x)} end"
    )


def compensated(values: str) -> str:
    """Sum of a list of doubles in order, with the rounding error of each step carried along."""
    lost = (
        "case when abs(p.hi) >= abs(q.hi) then (p.hi - (p.hi + q.hi)) + q.hi "
        "else (q.hi - (p.hi + q.hi)) + p.hi end"
    )
    pairs = f"list_transform({values}, lambda x: {{'hi': x, 'lo': 0::double}})"
    step = f"lambda p, q: {{'hi': p.hi + q.hi, 'lo': p.lo + {lost}}}"
    return f"(list_transform([list_reduce({pairs}, {step})], lambda s: s.hi + s.lo)[1])"


INVOICES = f"""
line as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, p_name, p_retailprice, s_name
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
numbered as (
  select *, row_number() over (partition by l_orderkey
              order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) rn,
         l_orderkey % 8 v
  from line),
printed as (
  select *, concat('| ', case when v=7 then replace(p_name,' ','^{{}}[]  ')
                              when v=4 then replace(p_name,'e','c') else p_name end,
       ' | ', cast(cast(l_quantity as bigint) as varchar), ' | $',
       case when v=2 then replace({money('l_extendedprice')},'0','O')
            when v=3 then {sep('l_extendedprice')} else {money('l_extendedprice')} end, ' |') printed_line
  from numbered),
sheet as (
  select l_orderkey, count(*) n_items, string_agg(printed_line, chr(10) order by rn) printed_lines,
         min(case when rn=1 then s_name end) supplier_name
  from printed group by l_orderkey),
raw as (
  select o_orderkey doc_id, o_orderkey % 8 v, o_orderdate, o_totalprice,
         coalesce(n_items,0) n_items, printed_lines, supplier_name, c_name customer_name,
         concat('INV-', lpad(cast(o_orderkey as varchar), 8, '0')) document_number,
         strftime(o_orderdate, '%Y-%m-%d') d
  from orders left join sheet on l_orderkey = o_orderkey join customer on c_custkey = o_custkey),
parts as (
  select *, case when v=6 then null else d end document_date,
         case when v=7 then -o_totalprice else o_totalprice end amount,
         case when v=4 then strftime(o_orderdate, '%d/%m/%Y') else d end ocr_date,
         case when v=1 then '' else coalesce(supplier_name,'') end ocr_supplier,
         case when v=2 then replace(customer_name,'m','rn') else customer_name end ocr_customer,
         case when v=3 then {sep('o_totalprice')}
              when v=5 then cast(cast(floor(o_totalprice) as bigint) as varchar)
              else {money('o_totalprice')} end ocr_total
  from raw),
heads as (
  select *, concat('# INVOICE ', document_number, chr(10), 'Date: ', ocr_date, chr(10),
                   ocr_supplier, chr(10), ocr_customer) ocr_head,
         concat(coalesce(printed_lines || chr(10), ''), 'TOTAL $', ocr_total, chr(10)) ocr_body
  from parts),
invoices as (select *, concat(ocr_head, chr(10), ocr_body) ocr_text from heads),
items as (
  select l_orderkey doc_id, rn item, p_name description, l_quantity quantity,
         p_retailprice unit_price, l_extendedprice total
  from numbered)
"""


def ratio_of(pairs: str) -> str:
    """CTEs giving ``rated(a, b, ratio)`` for the distinct pairs of ``pairs(a, b)``.

    Longest common block first (ties: earliest in a, then in b), then the same
    to its left and right; the ratio is twice the matched length over the total.
    """
    return f"""
pair as (select row_number() over () pid, a, b from (select distinct a, b from {pairs})),
cell as (
  select pid, i, j, list_max([n for n in range(1, least(length(a)-i, length(b)-j)+1)
                              if substr(a,i+1,n) = substr(b,j+1,n)]) k
  from (select *, unnest(range(length(a))) i from pair) x,
       lateral (select unnest(range(length(x.b))) j) y
  where substr(a,i+1,1) = substr(b,j+1,1)),
win as (
  select pid, 0::bigint alo, length(a)::bigint ahi, 0::bigint blo, length(b)::bigint bhi, 0::bigint m from pair
  union all
  select pid, case side when 0 then alo else bi+k end, case side when 0 then bi else ahi end,
         case side when 0 then blo else bj+k end, case side when 0 then bj else bhi end,
         case side when 0 then k else 0 end
  from (select win.pid, win.alo, win.ahi, win.blo, win.bhi,
               arg_min({{'i':c.i, 'j':c.j, 'k':least(c.k, win.ahi-c.i, win.bhi-c.j)}},
                       (-(least(c.k, win.ahi-c.i, win.bhi-c.j)), c.i, c.j)) best
        from win join cell c on c.pid=win.pid and c.i>=win.alo and c.i<win.ahi and c.j>=win.blo and c.j<win.bhi
        group by win.pid, win.alo, win.ahi, win.blo, win.bhi) z,
       lateral (select z.best.i bi, z.best.j bj, z.best.k k) q, (values (0),(1)) s(side)),
rated as (
  select any_value(pair.a) a, any_value(pair.b) b,
         2.0*sum(win.m)::double / (length(any_value(pair.a)) + length(any_value(pair.b))) ratio
  from win join pair using (pid) group by pair.pid)
"""


def grounded(texts: str, values: str, t: float = 0.8) -> str:
    """CTEs from ``texts(doc_id, txt)`` and ``values(doc_id, item, field, value)`` to
    ``scored(doc_id, item, field, value, found, raw)``."""
    return f"""
norm_text as (select doc_id, {norm('txt')} nt from {texts}),
probe as (select doc_id, item, field, value, {norm('value')} nv from {values}),
settled as (
  select p.*, value is null or value = '' or contains(nt, nv) hit, nt,
         [w for w in string_split(nv, ' ') if w <> ''] ws
  from probe p join norm_text using (doc_id)),
wanted as (
  select doc_id, item, field, unnest(ws) w, unnest(range(len(ws))) pos
  from settled where not hit),
text_word as (
  select distinct doc_id, unnest(string_split(nt, ' ')) w
  from norm_text where doc_id in (select doc_id from wanted)),
cand as (
  select x.doc_id, x.item, x.field, x.pos, x.w a, y.w b
  from wanted x join text_word y on x.doc_id = y.doc_id and y.w <> ''
   and 2.0 * least(length(x.w), length(y.w)) >= {t - 1e-9} * (length(x.w) + length(y.w))),
unequal as (select a, b from cand where a <> b),
{ratio_of('unequal')},
word_best as (
  select x.doc_id, x.item, x.field, x.pos,
         coalesce(max(case when c.a = c.b then 1.0 else r.ratio end), 0.0) best
  from wanted x left join cand c on c.doc_id=x.doc_id and c.item=x.item and c.field=x.field and c.pos=x.pos
       left join rated r on r.a = c.a and r.b = c.b
  group by all),
folded as (
  select doc_id, item, field, count(*) n, count(*) filter (best >= {t}) hits,
         list_reduce(list(case when best >= {t} then best else 0.0 end order by pos), lambda p, q: p + q) total
  from word_best group by all),
scored as (
  select s.doc_id, s.item, s.field, s.value,
         case when s.hit or len(s.ws)=0 then true else f.hits = f.n end found,
         case when s.hit or len(s.ws)=0 then 1.0 when f.hits = 0 then 0.0 else f.total / f.n end raw
  from settled s left join folded f using (doc_id, item, field))
"""


INVOICE_TEXTS = "texts as (select doc_id, ocr_text txt from invoices)"

SCALAR_VALUES = """
scalar_values as (
  select doc_id, 0 item, 'document_number' field, document_number value from invoices
  union all select doc_id, 0, 'document_date', document_date from invoices
  union all select doc_id, 0, 'supplier_name', supplier_name from invoices
  union all select doc_id, 0, 'customer_name', customer_name from invoices
  union all select doc_id, 0, 'total_amount', format('{:.2f}', amount) from invoices)
"""

ITEM_VALUES = """
item_values as (
  select doc_id, item, 'description' field, description value from items
  union all select doc_id, item, 'total', format('{:.2f}', total) from items)
"""

ALL_VALUES = "all_values as (select * from scalar_values union all select * from item_values)"

NOTE = (
    "case when value is null then 'Field is null' when raw = 1.0 then 'exact match' "
    "when found then 'fuzzy match' else 'not found in OCR' end"
)


def comparisons(t: float = 0.8, before: str = "", values: str = "all_values") -> str:
    """CTE ``comparison(doc_id, field, extracted, found_in_ocr, confidence, note)`` and before it
    ``item_score(doc_id, item, description_confidence, total_confidence, confidence)``."""
    return f"""
{INVOICES}, {INVOICE_TEXTS}, {SCALAR_VALUES}, {ITEM_VALUES}, {ALL_VALUES},{before}
{grounded('texts', values, t)},
item_part as (
  select doc_id, item, max(case when field='description' then {round3('raw')} end) description_confidence,
         max(case when field='total' then {round3('raw')} end) total_confidence
  from scored where item > 0 group by doc_id, item),
item_score as (
  select *, (description_confidence + total_confidence) / 2 confidence from item_part),
item_mean as (
  select doc_id, count(*) n,
         {compensated('list(confidence order by item)')} / count(*) mean
  from item_score group by doc_id),
comparison as (
  select doc_id, field, value extracted, found found_in_ocr, {round3('raw')} confidence, {NOTE} note
  from scored where item = 0
  union all
  select doc_id, 'line_items', concat(cast(n as varchar), ' items'), mean > {t}, {round3('mean')},
         concat('average across ', cast(n as varchar), ' items')
  from item_mean)
"""


def confidence_of(weights: dict[str, float]) -> str:
    """Select giving the overall confidence and band counts from ``comparison``."""
    order = ["document_number", "document_date", "supplier_name", "customer_name", "total_amount", "line_items"]
    w = {f: weights.get(f, 1.0) for f in order}
    cols = ", ".join(f"max(case when field='{f}' then confidence end) {f}" for f in order)
    scored = " + ".join(f"{f}*{w[f]!r}::double" for f in order[:-1])
    weight = " + ".join(f"{w[f]!r}::double" for f in order[:-1])
    last = w["line_items"]
    overall = (
        f"case when line_items is null then ({scored})/({weight}) "
        f"else ({scored} + line_items*{last!r}::double)/({weight} + {last!r}::double) end"
    )
    return f"""
select doc_id, {round3(overall)} overall_confidence, total_fields, high_confidence, medium_confidence, low_confidence
from (select doc_id, {cols}, count(*)::bigint total_fields,
             count(*) filter (confidence >= 0.9)::bigint high_confidence,
             count(*) filter (confidence >= 0.5 and confidence < 0.9)::bigint medium_confidence,
             count(*) filter (confidence < 0.5)::bigint low_confidence
      from comparison group by doc_id)
"""


DEFAULT_WEIGHTS = {
    "document_number": 1.5,
    "document_date": 1.2,
    "supplier_name": 1.0,
    "customer_name": 1.0,
    "total_amount": 2.0,
    "line_items": 1.0,
}
CUSTOM_WEIGHTS = {"document_number": 3.0, "total_amount": 1.0, "supplier_name": 0.0}



# -- small pieces ---------------------------------------------------------------

DOT1 = "{:.1f}"
AMOUNT2 = "{:.2f}"

PAGE_FILES = """
page_file as (
  select page_id, html, concat('p', cast(page_id as varchar),
           ['.pdf','.PNG','.jpg','.jpeg','.tar.gz','.xyz','','.mp4','.wav','.py'][cast(page_id % 10 as int) + 1]) name,
         strlen(html)::bigint size_bytes from pages),
typed as (
  select *, case page_id % 10 when 0 then 'pdf' when 1 then 'png' when 2 then 'jpg' when 3 then 'jpeg'
                             when 4 then 'gz' when 5 then 'xyz' when 6 then '' when 7 then 'mp4' when 8 then 'wav' else 'py' end extension,
         case page_id % 10 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'image/jpeg'
              when 3 then 'image/jpeg' when 4 then 'application/x-tar'
              when 7 then 'video/mp4' when 8 then 'audio/x-wav' when 9 then 'text/x-python' else 'application/octet-stream' end mime_type,
         page_id % 10 = 0 is_pdf
  from page_file),
sent as (
  select *, concat('data:', mime_type, ';base64,', to_base64(encode(html))) uri,
         case when is_pdf then 'document_url' else 'image_url' end document_type
  from typed)
"""

ROUTED = """
routed as (
  select *, ['text','hybrid','direct_pdf'][cast(v % 3 as int) + 1] mode,
         to_base64(encode(ocr_text)) encoded,
         case when doc_id % 5 = 0 then 'Totals only.' end custom
  from invoices)
"""

PARTY_JSON = (
    "case when {0} is null then 'null' else "
    "concat('{{\"name\":\"', {0}, '\",\"address\":null,\"tax_id\":null}}') end"
)


def party(name: str) -> str:
    return PARTY_JSON.format(name)


RECORD_JSON = f"""
item_json as (
  select doc_id, string_agg(concat('{{"description":"', description, '","quantity":', cast(quantity as varchar),
           ',"unit_price":', cast(unit_price as varchar), ',"total":', cast(total as varchar), '}}'),
           ',' order by item) item_list
  from items group by doc_id),
record as (
  select i.*, concat('[', coalesce(item_list, ''), ']') items_json,
         case when document_date is null then 'null' else concat('"', document_date, '"') end date_json
  from invoices i left join item_json using (doc_id))
"""

BODIES = f"""
body_item as (
  select doc_id, string_agg(concat('{{"description":"', description, '","quantity":',
           case when doc_id % 12 = 10 then '"many"' else {money('quantity')} end,
           case when doc_id % 12 = 2 then '' else concat(',"unit_price":', {money('unit_price')}) end,
           ',"total":', {money('total')}, case when doc_id % 12 = 1 then ',"sku":1}}' else '}}' end),
           ',' order by item) item_list
  from items group by doc_id),
whole as (
  select i.*, doc_id % 12 k, concat(case when doc_id % 12 = 1 then '{{"note":"x",' else '{{' end,
       '"document_type":', case when doc_id % 12 = 9 then 'null' else '"invoice"' end,
       ',"document_number":"', document_number, '"',
       case when doc_id % 12 = 2 then '' when doc_id % 12 = 3 then ',"document_date":20240101'
            when document_date is null then ',"document_date":null'
            else concat(',"document_date":"', document_date, '"') end,
       ',"supplier":', case when doc_id % 12 = 5 then 'null' else {party('supplier_name')} end,
       ',"customer":', {party('customer_name')},
       ',"total_amount":{{"amount":', case when doc_id % 12 = 3 then '"n/a"' else {money('amount')} end,
       ',"currency":"USD"}},"line_items":[',
       case doc_id % 12 when 6 then '1,2' when 7 then 'null' when 8 then '"x"' else coalesce(item_list, '') end, ']}}') full_body
  from invoices i left join body_item using (doc_id)),
answer as (
  select *, case when k = 4 then left(full_body, length(full_body) - 5) else full_body end body,
         concat('resp_', cast(doc_id as varchar)) response_id,
         (length(ocr_text) // 4)::bigint input_tokens, doc_id % 200 + 50 output_tokens
  from whole),
-- only whole bodies reach the JSON functions
valid as (select *, json_valid(body) ok, case when json_valid(body) then body end j from answer),
-- items as the answers give them; items of a wrong type are none
answer_items as (
  select doc_id, item, description, case when doc_id % 12 <> 10 then quantity end quantity,
         case when doc_id % 12 <> 2 then unit_price end unit_price, total
  from items where doc_id % 12 not in (4, 6, 7, 8)
  union all select doc_id, 1, null, null, null, null from invoices where doc_id % 12 = 7),
parsed as (
  select *, json_extract_string(j, '$.document_type') p_type,
         json_extract_string(j, '$.document_number') p_number,
         json_extract_string(j, '$.document_date') p_date,
         json_extract_string(j, '$.supplier.name') p_supplier,
         json_extract_string(j, '$.customer.name') p_customer,
         try_cast(json_extract_string(j, '$.total_amount.amount') as double) p_amount,
         json_extract_string(j, '$.total_amount.currency') p_currency,
         case when k not in (6, 8) then json_array_length(j, '$.line_items')::bigint end p_items,
         not ok or k in (3, 6, 8) or (k = 10 and n_items > 0) broken
  from valid)
"""

JUDGE_ROWS = """
judged_doc as (
  select d.doc_id, n_chars, quality, toxic from documents d left join labels l on l.doc_id = d.doc_id),
judge as (
  select doc_id, 'groundedness' metric, cast(1 + 4*quality as double) score,
         case when quality is null then 'no label' end error, n_chars,
         case when quality is not null then 'why groundedness' end reason from judged_doc
  union all
  select doc_id, 'relevance', cast(5 - 4*toxic as double), case when quality is null then 'no label' end, n_chars,
         case when quality is not null then 'why relevance' end
  from judged_doc
  union all
  select doc_id, 'coherence', cast(1 + doc_id % 5 as double), null, n_chars, 'why coherence' from judged_doc),
per_doc as (
  select doc_id, cast(1 + 4*quality as double) groundedness, cast(5 - 4*toxic as double) relevance,
         cast(1 + doc_id % 5 as double) coherence, quality is not null labelled from judged_doc)
"""

PAIRS = """
pairs as (
  select doc_id, 'customer' kind, 0 place, customer_name a, ocr_customer b from invoices
  union all select doc_id, 'supplier', 0, supplier_name, ocr_supplier from invoices
  union all
  select f.doc_id, 'items', f.item, f.description, l.description
  from items f join items l on l.doc_id = f.doc_id and l.item = f.item + 1)
"""

MODE_RUNS = """
runs as (
  select doc_id, concat('model-', lang) model, 'hybrid' mode, n_chars // 4 + 1000 input_tokens,
         doc_id % 200 + 50 output_tokens, (doc_id % 101) / 100 overall_confidence from documents
  union all
  select doc_id, concat('model-', lang), 'text_only', n_chars // 4, doc_id % 200 + 50, (doc_id % 97) / 100
  from documents)
"""

SIGNED_TOTAL = """
signed as (
  select o_orderkey doc_id, case when o_orderkey % 97 = 0 then 'nan'::double when o_orderkey % 89 = 0 then null
         when o_orderkey % 8 = 7 then -o_totalprice else o_totalprice * 100 end total from orders)
"""

FIND_NAMES = "('document_number','document_date','supplier_name','customer_name')"

def _schema(kind, nullable=True):
    """Strict JSON schema text of a type given as 'string', 'number', {name: (type, nullable)} or [item type]."""
    if isinstance(kind, dict):
        members = ",".join(f'"{n}":{_schema(*t)}' for n, t in kind.items())
        names = ",".join(f'"{n}"' for n in kind)
        text = f'{{"type":"object","properties":{{{members}}},"required":[{names}],"additionalProperties":false}}'
    elif isinstance(kind, list):
        text = f'{{"type":"array","items":{_schema(kind[0], False)}}}'
    else:
        text = f'{{"type":"{kind}"}}'
    return f'{{"anyOf":[{text},{{"type":"null"}}]}}' if nullable else text


_PARTY = {"name": ("string", False), "address": ("string",), "tax_id": ("string",)}
_MONEY = {"amount": ("number", False), "currency": ("string", False)}
_ITEM = {"description": ("string", False), "quantity": ("number",), "unit_price": ("number",), "total": ("number",)}
RECORD_SCHEMA = _schema(
    {
        "document_type": ("string", False), "document_number": ("string",), "document_date": ("string",),
        "supplier": (_PARTY,), "customer": (_PARTY,), "total_amount": (_MONEY,), "line_items": ([_ITEM], False),
    },
    False,
)

RESULT_FIELDS = ["document_number", "document_date", "supplier_name", "customer_name", "total_amount", "line_items"]


def field_columns(names: list[str]) -> str:
    """Confidence and note of each field, one row per document, from ``comparison``."""
    return ", ".join(
        f"max(case when field='{n}' then {part} end) {n}_{part}" for n in names for part in ("confidence", "note")
    )


def flow_state(answered: str) -> str:
    """CTE ``state``: what each document has, and the errors that follow; ``answered`` gives doc_id, ok, misfit."""
    return f"""
state as (
  select i.doc_id, i.doc_id % 2 = 1 direct, i.doc_id % 2 = 0 and i.doc_id % 13 <> 0 and i.doc_id % 17 <> 1 readable,
         a.doc_id is not null and i.doc_id % 19 <> 2 answered,
         coalesce(ok, false) and i.doc_id % 19 <> 2 ok, coalesce(misfit, false) and i.doc_id % 19 <> 2 misfit,
         i.doc_id % 23 <> 3 judged
  from invoices i left join {answered} a using (doc_id)),
stated as (
  select *, nullif(concat_ws(',', case when not direct and doc_id % 13 = 0 then 'ocr_missing' end,
       case when not direct and doc_id % 13 <> 0 and doc_id % 17 = 1 then 'ocr_unreadable' end,
       case when not answered then 'answer_missing' end,
       case when answered and not ok then 'answer_unreadable' end, case when misfit then 'answer_misfit' end), '') error
  from state)"""


def flow() -> str:
    """The full flow: records as the answers hold them, grounded in the invoice texts."""
    before = f"""
parsed as (
  select *, doc_id % 12 k, doc_id % 12 <> 4 ok,
         doc_id % 12 in (3, 6, 8) or (doc_id % 12 = 10 and n_items > 0) misfit,
         case when doc_id % 12 <> 4 then document_number end p_number,
         case doc_id % 12 when 2 then null when 3 then '20240101' else document_date end p_date,
         case when doc_id % 12 <> 5 then supplier_name end p_supplier,
         customer_name p_customer,
         case when doc_id % 12 <> 3 then amount end p_amount
  from invoices),
flow_values as (
  select doc_id, 0 item, 'document_number' field, p_number value from parsed where ok
  union all select doc_id, 0, 'document_date', p_date from parsed where ok
  union all select doc_id, 0, 'supplier_name', p_supplier from parsed where ok
  union all select doc_id, 0, 'customer_name', p_customer from parsed where ok
  union all select doc_id, 0, 'total_amount', case when p_amount is not null then format('{AMOUNT2}', p_amount) end
    from parsed where ok
  union all select doc_id, item, field, value from item_values where doc_id % 12 not in (4, 6, 7, 8)),
"""
    metrics = ", ".join(
        f"case when shown then {score} end {m}_score, case when shown then {error} end {m}_error, "
        f"case when shown then case when {score} >= 3 then 'pass' when {score} is not null then 'fail' end end {m}_result, "
        f"case when shown then 'why {m}' end {m}_reason"
        for m, score, error in (
            ("groundedness", "score", "null::varchar"),
            ("relevance", "case when not late then score end", "case when late then 'timed out' end"),
            ("coherence", "score", "null::varchar"),
        )
    )
    names = ", ".join(f"case when scored then {n}_{p} end {n}_{p}" for n in RESULT_FIELDS for p in ("confidence", "note"))
    return f"""with recursive {comparisons(before=before, values='flow_values')},
confident as ({confidence_of(DEFAULT_WEIGHTS)}),
of_field as (select doc_id, {field_columns(RESULT_FIELDS)} from comparison group by doc_id),
{flow_state('parsed')},
rated_flow as (
  select p.doc_id, p.document_number, p.p_number, p.p_date, p.ocr_text, o_totalprice, direct, readable, stated.ok, stated.error,
         case when direct then 'direct_pdf' else 'hybrid' end mode, readable and stated.ok scored,
         judged and stated.ok shown, doc_id % 7 = 0 late, (doc_id % 5 + 1)::double score,
         (p_date is null or p_date = '' or regexp_full_match(p_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}'))::bigint date_ok,
         (p_amount is null or p_amount >= 0)::bigint amount_ok
  from parsed p join stated using (doc_id)),
valued as (select *, (date_ok + amount_ok) / 2 validation from rated_flow)
select r.doc_id, mode, concat(document_number, case when direct then '.pdf' else '.png' end) name,
  {round3('floor(o_totalprice * 10) / 1048576.0::double')} size_mb,
  case when readable then 2::bigint end pages_processed,
  case when readable then (length(ocr_text) + 1)::bigint end text_length,
  case when readable then concat(ocr_head_text, chr(10), chr(10), ocr_body_text) end full_text,
  case when ok then p_number end document_number,
  case when ok then case mode when 'hybrid' then 'hybrid_ocr_vision' else mode end end recorded_mode,
  case when scored then overall_confidence end overall_confidence,
  case when scored then total_fields end total_fields,
  case when scored then high_confidence end high_confidence,
  {names}, {metrics},
  case when shown then p_date end checked_date,
  case when shown then date_ok + amount_ok end passed_checks,
  case when shown then 2::bigint end total_checks,
  case when shown then case when late then {compensated('[score/5*0.25::double, score/5*0.25::double, validation*0.15::double]')}
         / {compensated('[0.25::double, 0.25::double, 0.15::double]')}
    else {compensated('[score/5*0.25::double, score/5*0.25::double, score/5*0.25::double, validation*0.15::double]')}
         / {compensated('[0.25::double, 0.25::double, 0.25::double, 0.15::double]')} end end overall_score,
  error
from valued r left join confident using (doc_id) left join of_field using (doc_id)
  join (select doc_id, ocr_head ocr_head_text, ocr_body ocr_body_text from invoices) using (doc_id)
"""


def custom_flow() -> str:
    """Receipts through the flow: own fields, one of which the record hasn't got."""
    names = ["store_name", "date", "total", "cashier"]
    before = f"""
receipt_values as (
  select doc_id, 0 item, 'store_name' field, coalesce(supplier_name, '') value from invoices
  union all select doc_id, 0, 'date', coalesce(document_date, '') from invoices
  union all select doc_id, 0, 'total', format('{AMOUNT2}', amount) from invoices
  union all select doc_id, 0, 'cashier', null from invoices),
"""
    shown = ", ".join(f"case when readable and ok then {n}_{p} end {n}_{p}" for n in names for p in ("confidence", "note"))
    scored = " + ".join(f"{n}_confidence*1.0::double" for n in names)
    return f"""with recursive {comparisons(before=before, values='receipt_values')},
of_field as (select doc_id, {field_columns(names)} from comparison group by doc_id),
read_receipt as (select doc_id, true ok, false misfit from invoices),
{flow_state('read_receipt')}
select doc_id, case when ok then coalesce(supplier_name, '') end store_name, case when ok then amount end total,
  case when readable and ok then {round3(f'({scored}) / 4.0::double')} end overall_confidence,
  {shown}, case when judged and ok then 1::bigint end total_checks, error
from stated join invoices using (doc_id) left join of_field using (doc_id)
"""


def queries() -> dict[str, str]:
    """SQL text by query name."""
    ground = comparisons()
    sql = {}

    sql["normalize_text"] = f"select doc_id, {norm('text')} normalized from documents"
    number = r"regexp_extract(replace(t, ',', ''), '[\p{Nd},]+\.?\p{Nd}*')"
    sql["normalize_amount"] = f"""
select 'line' source, l_orderkey "key", format('{AMOUNT2}', l_extendedprice * l_discount) normalized from lineitem
union all
select 'order', o_orderkey, case when {number} <> '' then format('{AMOUNT2}', cast({number} as double)) else {norm('t')} end
from (select o_orderkey, case when o_orderkey % 50 = 0 then 'n/a' when o_orderkey % 50 = 1 then ''
             else concat('USD -', {sep('o_totalprice')}) end t from orders)"""
    sql["text_preview"] = """
select doc_id, length(text)::bigint text_length,
       case when length(text) > 500 then substr(text, 1, 500) || '...' else text end text_preview from documents"""
    sql["file_info"] = f"""with {PAGE_FILES}
select page_id, 'in/v1.2/' || name path, name, extension, size_bytes,
       {round3('size_bytes / 1048576.0::double')} size_mb, is_pdf from typed"""
    sql["mime_type"] = f"with {PAGE_FILES} select page_id, mime_type from typed"
    sql["data_uri"] = f"with {PAGE_FILES} select page_id, uri data_uri from sent"
    sql["route_mode"] = f"""with {PAGE_FILES}
select page_id, case when is_pdf and page_id % 2 = 0 then 'direct_pdf'
                     when page_id % 4 = 0 then 'hybrid' else 'text' end route from typed"""

    sql["page_concat"] = """
select conv_id, count(*)::bigint pages_processed, string_agg(text, chr(10) || chr(10) order by turn) full_text,
       length(string_agg(text, chr(10) || chr(10) order by turn))::bigint text_length
from conversations group by conv_id"""
    sql["page_totals"] = """
select conv_id, count(*)::bigint pages_processed,
       length(string_agg(text, chr(10) || chr(10)))::bigint text_length from conversations group by conv_id"""
    sql["parse_ocr_response"] = """
select doc_id, case when fine then (length(text) - length(replace(text, chr(10), '')) + 1)::bigint end pages_processed,
       case when fine then replace(text, chr(10), chr(10) || chr(10)) end full_text,
       case when fine then length(replace(text, chr(10), chr(10) || chr(10)))::bigint end text_length,
       case when doc_id % 17 = 1 then '{}' when doc_id % 17 = 0 then
         concat('{"pages":[', array_to_string(list_transform(string_split(text, chr(10)),
           lambda l: case when l = '' then '{}' else concat('{"markdown":', to_json(l), '}') end), ','), ']') end ocr_error
from (select *, doc_id % 17 not in (0, 1, 2) fine from documents)"""

    sql["ocr_request"] = f"""with {PAGE_FILES}
select page_id, 'model-1' model, document_type, uri document_url, false include_image_base64,
       concat('{{"model":"model-1","document":{{"type":"', document_type, '","', document_type, '":"', uri,
              '"}},"include_image_base64":false}}') payload from sent"""
    sql["extract_request"] = f"""with {INVOICES}, {ROUTED},
doc_part as (
  select *, concat('{{"type":"input_text","text":',
      to_json(concat('Text of the document:', chr(10), ocr_text, chr(10), 'End of the text.')), '}}') text_part from routed),
sent_doc as (
select doc_id, mode, 'model-1' model,
       coalesce(custom, case mode when 'hybrid' then 'Fill the schema from the image; the text only helps reading it.'
          when 'direct_pdf' then 'Fill the schema from the attached file; leave out what is not stated.'
          else 'Fill the schema from the document text; leave out what is not stated.' end) instructions,
       'document_extraction' schema_name, true strict, 0 temperature, '{RECORD_SCHEMA}' schema_json,
       case mode when 'text' then concat('[', text_part, ']')
         when 'hybrid' then concat('[{{"type":"input_image","image_url":"data:image/png;base64,', encoded, '"}},', text_part, ']')
         else concat('[{{"type":"input_file","filename":"', document_number,
            '.pdf","file_data":"data:application/pdf;base64,', encoded,
            '"}},{{"type":"input_text","text":"Fill the schema from the file."}}]') end content
from doc_part)
select *, concat('{{"model":"model-1","instructions":', to_json(instructions), ',"input":[{{"role":"user","content":', content,
  '}}],"text":{{"format":{{"type":"json_schema","name":"document_extraction","schema":', schema_json,
  ',"strict":true}}}},"temperature":0}}') payload from sent_doc"""
    record = f"""concat('{{"document_type":"invoice","document_number":"', document_number, '","document_date":', date_json,
      ',"supplier":', {party('supplier_name')}, ',"customer":', {party('customer_name')},
      ',"total_amount":{{"amount":', cast(amount as varchar), ',"currency":"USD"}},"line_items":', items_json, '}}')"""
    sql["judge_request"] = f"""with {INVOICES}, {RECORD_JSON}
select doc_id, metric, 'Fill the schema from the document.' query,
       case when metric = 'coherence' then null
            when v % 3 = 2 then '(the file was read by the model itself)' else ocr_text end context,
       {record} response
from record, (values ('groundedness'), ('relevance'), ('coherence')) m(metric)"""
    sql["export_json"] = f"""with {INVOICES}, {RECORD_JSON}
select doc_id, concat('{{"document_type":"invoice","document_number":"', document_number, '","document_date":', date_json,
      ',"supplier":', {party('supplier_name')}, ',"customer":', {party('customer_name')},
      ',"total_amount":{{"amount":', cast(amount as varchar),
      ',"currency":"USD"}},"line_items":', items_json, '}}') result from record"""
    sql["response_attach"] = """
select o_orderkey doc_id, case when o_orderkey % 11 <> 0 then concat('resp_', cast(o_orderkey as varchar)) end response_id,
       case when o_orderkey % 11 <> 0 then o_orderkey % 200 + 50 end output_tokens from orders"""
    sql["model_apply"] = f"""with {INVOICES}
select doc_id, case when ocr_supplier <> '' then sha256(ocr_text) end response,
       case when ocr_supplier = '' then 'ValueError: supplier line is blank' end error from invoices"""
    sql["model_resume"] = f"""with {INVOICES},
sent as (select doc_id, ocr_supplier, sha256(ocr_text) d, substr(sha256(ocr_text), 1, 1) in ('0','3','6','9','c','f') busy from invoices)
select doc_id, case when ocr_supplier <> '' then concat(case when busy then 'second ' else 'first ' end, d) end response,
       case when ocr_supplier = '' then 'ValueError: supplier line is blank' end error,
       case when ocr_supplier = '' or busy then 2 else 1 end::bigint sends from sent"""
    sql["response_parse"] = f"""with {INVOICES}, {BODIES}
select p.doc_id, ok has_record, p_type document_type, p_number document_number, p_date document_date, p_supplier supplier_name,
       p_customer customer_name, p_amount amount, p_currency currency,
       case when ok then p_items end n_items, a.item::int item, a.description, a.quantity, a.unit_price, a.total,
       'model-1' model, response_id, 'hybrid_ocr_vision' mode, input_tokens, output_tokens,
       case when broken then body end parse_error
from parsed p left join answer_items a on a.doc_id = p.doc_id and ok"""
    declared = "['document_type','document_number','document_date','supplier','customer','total_amount','line_items']"
    # type of every declared path: pattern of the JSON type, and whether null is allowed
    rules = """
('document_type','VARCHAR',false),('document_number','VARCHAR',true),('document_date','VARCHAR',true),
('supplier','OBJECT',true),('supplier.name','VARCHAR',false),('supplier.address','VARCHAR',true),('supplier.tax_id','VARCHAR',true),
('customer','OBJECT',true),('customer.name','VARCHAR',false),('customer.address','VARCHAR',true),('customer.tax_id','VARCHAR',true),
('total_amount','OBJECT',true),('total_amount.amount','DOUBLE|.*BIGINT',false),('total_amount.currency','VARCHAR',false),
('line_items','ARRAY',false)"""
    item_rules = """
('','OBJECT',false),('.description','VARCHAR',false),('.quantity','DOUBLE|.*BIGINT',true),
('.unit_price','DOUBLE|.*BIGINT',true),('.total','DOUBLE|.*BIGINT',true)"""
    sql["schema_conformance"] = f"""with {INVOICES}, {BODIES},
item_value as (select doc_id, unnest(json_extract(j, '$.line_items[*]')) v from parsed where ok),
members as (
  select doc_id, '' prefix, json_keys(j) present, {declared} declared from parsed where ok
  union all
  select doc_id, p || '.', json_keys(j, '$.' || p), ['name','address','tax_id']
  from parsed, (values ('supplier'), ('customer')) n(p) where ok and json_type(j, '$.' || p) = 'OBJECT'
  union all
  select doc_id, 'total_amount.', json_keys(j, '$.total_amount'), ['amount','currency'] from parsed where ok
  union all
  select doc_id, 'line_items[].', json_keys(v), ['description','quantity','unit_price','total']
  from item_value where json_type(v) = 'OBJECT'),
typed_value as (
  select doc_id, path, fits, nullable, json_type(j, '$.' || path) t from parsed, (values {rules}) r(path, fits, nullable) where ok
  union all
  select doc_id, 'line_items[]' || path, fits, nullable, json_type(v, '$' || path)
  from item_value, (values {item_rules}) r(path, fits, nullable)),
problem as (
  select doc_id, 'missing' kind, prefix || unnest([k for k in declared if not list_contains(present, k)]) path from members
  union all
  select doc_id, 'extra', prefix || unnest([k for k in present if not list_contains(declared, k)]) from members
  union all
  select doc_id, 'type', path from typed_value
  where t is not null and case when t = 'NULL' then not nullable else not regexp_full_match(t, fits) end),
listed as (
  select doc_id, coalesce(string_agg(distinct path, ',' order by path) filter (kind='missing'), '') missing_keys,
         coalesce(string_agg(distinct path, ',' order by path) filter (kind='extra'), '') extra_keys,
         coalesce(string_agg(distinct path, ',' order by path) filter (kind='type'), '') wrong_types
  from problem group by doc_id)
select doc_id, ok well_formed, coalesce(missing_keys, '') missing_keys, coalesce(extra_keys, '') extra_keys,
       coalesce(wrong_types, '') wrong_types, ok and listed.doc_id is null conforms
from parsed left join listed using (doc_id)"""
    paths = lambda when: {k: "''" for k in ("missing_keys", "extra_keys", "wrong_types", "wrong_values", "no_branch")} | when
    listed = lambda when: ", ".join(f"{v} {k}" for k, v in paths(when).items())
    sql["schema_union"] = f"""with kinds as (select o_orderkey doc_id, o_orderkey % 10 k from orders join customer on c_custkey = o_custkey)
select doc_id, k <> 9 well_formed, k = 0 conforms, {listed({
        "missing_keys": "case k when 4 then 'payer.name' else '' end",
        "extra_keys": "case k when 6 then 'payee.vat' else '' end",
        "wrong_types": "case k when 5 then 'payee' when 8 then 'amounts[].amount' else '' end",
        "wrong_values": "case k when 3 then 'method' else '' end",
        "no_branch": "case k when 1 then 'method' when 2 then 'method' when 7 then 'amounts[]' else '' end",
    })} from kinds"""
    sql["schema_recursive"] = f"""with {INVOICES},
kinds as (select doc_id, doc_id % 6 k, n_items::int n, concat('lines', repeat('.next', n_items::int - 1)) last from invoices)
select doc_id, k <> 5 well_formed, k = 0 or (n = 0 and k in (1, 2, 3)) conforms, {listed({
        "missing_keys": "case when k = 2 and n > 0 then last || '.description' else '' end",
        "extra_keys": """case when k = 3 then array_to_string(list_sort(list_transform(range(n),
          lambda i: concat('lines', repeat('.next', i), '.sku'))), ',') else '' end""",
        "wrong_types": "case when k = 1 and n > 0 then last || '.quantity' else '' end",
        "no_branch": "case when k = 4 then 'sum' || repeat('.left', n) else '' end",
    })} from kinds"""
    sql["custom_schema"] = f"""with {INVOICES}
select i.doc_id, 'receipt' schema_name, coalesce(supplier_name, '') store_name, cast(null as varchar) store_address,
       coalesce(document_date, '') date, amount subtotal, 0.0::double tax, amount total, cast(null as varchar) payment_method,
       n_items::bigint n_items, f.item::int item, f.description "name", cast(null as varchar) parse_error
from invoices i left join items f on f.doc_id = i.doc_id"""

    sql["text_similarity"] = f"""with recursive {INVOICES}, {PAIRS},
sides as (select *, {norm('a')} na, {norm('b')} nb from pairs),
known as (
  select *, case when coalesce(a,'') = '' and coalesce(b,'') = '' then 1.0
                 when coalesce(a,'') = '' or coalesce(b,'') = '' then 0.0
                 when na = nb then 1.0 when contains(na, nb) or contains(nb, na) then 0.95 end::double fixed
  from sides),
open as (select na a, nb b from known where fixed is null),
{ratio_of('open')}
select doc_id, kind, place, coalesce(fixed, ratio) similarity
from known left join rated on fixed is null and rated.a = na and rated.b = nb"""
    sql["gestalt_ratio"] = f"""with recursive {INVOICES}, {PAIRS},
open as (select a, b from pairs where a <> '' and b <> ''),
{ratio_of('open')}
select doc_id, kind, place, case when p.a is null or p.b is null then null when p.a = '' and p.b = '' then 1.0
                          when p.a = '' or p.b = '' then 0.0 else ratio end ratio
from pairs p left join rated r on r.a = p.a and r.b = p.b"""
    sql["find_exact"] = f"""
with vals as (
  select doc_id, text, 'last line' kind, string_split(text, chr(10))[-1] value from documents
  union all select doc_id, text, 'origin', concat_ws(' ', lang, source) from documents)
select doc_id, kind, value is null or value = '' or contains({norm('text')}, {norm('value')}) found from vals"""
    for name, t in (("find_fuzzy", 0.8), ("find_fuzzy_t07", 0.7)):
        sql[name] = f"""with recursive {INVOICES}, {INVOICE_TEXTS}, {SCALAR_VALUES},
named_values as (select * from scalar_values where field in {FIND_NAMES}),
{grounded('texts', 'named_values', t)}
select doc_id, field, found, raw confidence from scored"""
    sql["find_fuzzy_documents"] = f"""with recursive texts as (select doc_id, text txt from documents),
line_values as (
  select doc_id, 0 item, 'line' field, replace(string_split(text, chr(10))[1], 'e', 'c') value from documents),
{grounded('texts', 'line_values')}
select doc_id, found, raw confidence from scored"""
    sql["find_fuzzy_spread"] = sql["find_fuzzy_documents"]
    sql["field_scores"] = f"with recursive {ground} select * from comparison"
    sql["line_item_scores"] = f"""with recursive {ground}
select doc_id, item::int item, description_confidence, total_confidence, confidence from item_score"""
    sql["doc_confidence"] = f"with recursive {ground} {confidence_of(DEFAULT_WEIGHTS)}"
    sql["doc_confidence_weighted"] = f"with recursive {ground} {confidence_of(CUSTOM_WEIGHTS)}"
    sql["confidence_report"] = f"""with recursive {ground}, confident as ({confidence_of(DEFAULT_WEIGHTS)})
select doc_id, overall_confidence, 'ocr_extraction_comparison' "method", field "name", field, extracted, found_in_ocr, confidence,
       note, total_fields, high_confidence, medium_confidence, low_confidence
from confident join comparison using (doc_id)"""
    sql["field_scores_text"] = f"""with recursive priced as (select o_orderkey k, o_totalprice p from orders),
texts as (
  select k doc_id, concat('size ', cast(k + 20000000 as varchar), '.0 total ',
         case when k % 5 = 1 then cast(cast(floor(p) as bigint) as varchar) else {money('p')} end) txt from priced),
amount_values as (
  select k doc_id, 0 item, 'amount' field, case k % 5 when 0 then {money('p')} when 1 then {money('p')}
         when 2 then 'n/a' when 3 then '' end value from priced
  union all select k, 0, 'size', concat(cast(k + 20000000 as varchar), '.0') from priced),
{grounded('texts', 'amount_values')}
select doc_id, field, value extracted, found found_in_ocr, {round3('raw')} confidence, {NOTE} note from scored"""
    sql["field_quality"] = f"""with recursive {ground}
select field, count(*)::bigint documents,
       cast(sum(cast(confidence as decimal(10,3))) as double) / count(*) mean_confidence,
       count(*) filter (not found_in_ocr)::bigint not_found,
       count(*) filter (confidence >= 0.9)::bigint high_confidence,
       count(*) filter (confidence >= 0.5 and confidence < 0.9)::bigint medium_confidence,
       count(*) filter (confidence < 0.5)::bigint low_confidence
from comparison group by field"""

    sql["validate_date"] = """
with given as (
  select o_orderkey doc_id, case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d')
         when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then '2024-99-99' when 3 then '' when 4 then null
         else strftime(o_orderdate, '%Y-%-m-%-d') end d from orders)
select doc_id, coalesce(d = '' or regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}'), true) valid,
       case when coalesce(d, '') = '' then 'No date provided (optional)'
            when regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') then 'Valid format'
            else 'Invalid format: ' || d end message from given""".replace("\\\\", "\\")
    sql["validate_amount"] = f"""with {SIGNED_TOTAL}
select doc_id, total is null or (total >= 0 and not isnan(total)) valid,
       case when total is null then 'No amount provided (optional)'
            when total >= 0 and not isnan(total) then 'Valid amount: ' || cast(total as varchar)
            else 'Negative amount: ' || cast(total as varchar) end message from signed"""
    sql["validation_score"] = f"""with {SIGNED_TOTAL},
checked as (
  select doc_id, case when doc_id % 4 in (0, 2) then 0 else 1 end + case when total >= 0 and not isnan(total) then 1 else 0 end passed,
         case when total is null then 1 else 2 end total_checks from signed)
select doc_id, total_checks::bigint total_checks, passed::bigint passed_checks,
       (total_checks - passed)::bigint failed_checks, passed / total_checks validation_score from checked"""
    sql["judge_scores"] = f"""with {JUDGE_ROWS}
select doc_id, metric, score, error, reason, 3.0::double threshold, 'judge-' || metric model,
       n_chars // 4 + doc_id % 50 + 10 total_tokens, case when score >= 3 then 'pass' when score is not null then 'fail' end result,
       case when error is not null then 'error' when score >= 4 then 'ok' else 'check' end band from judge"""
    third = "(case doc_id % 3 when 0 then 1.0 when 1 then 0.5 else 0.0 end)::double"
    sql["overall_quality"] = f"""with {JUDGE_ROWS}
select doc_id, groundedness, relevance, coherence,
       case when labelled then
           {compensated(f'[groundedness/5*0.25::double, relevance/5*0.25::double, coherence/5*0.25::double, {third}*0.15::double]')}
           / {compensated('[0.25::double, 0.25::double, 0.25::double, 0.15::double]')}
         else {compensated(f'[coherence/5*0.25::double, {third}*0.15::double]')} / {compensated('[0.25::double, 0.15::double]')}
       end overall_score
from per_doc"""
    sql["diagnose"] = f"""with {JUDGE_ROWS},
matched as (select *, [1.0, 0.85, 0.0, 0.97, 0.4][cast(doc_id // 5 % 5 as int) + 1] f from per_doc)
select doc_id, case
    when f = 1 and groundedness = 5 and relevance = 5 and coherence = 5 then 'consistent'
    when f >= 0.7 and f < 1 and groundedness = 5 and relevance = 5 and coherence = 5 then 'noisy_text'
    when f = 0 and groundedness = 5 and relevance = 5 and coherence = 5 then 'restated'
    when f = 1 and groundedness = 5 and relevance <= 2 and coherence = 5 then 'misplaced'
    when f = 1 and groundedness = 5 and relevance = 5 and coherence <= 2 then 'inconsistent'
    when f = 0 and groundedness <= 2 then 'unsupported' else 'undecided' end diagnosis from matched"""

    sql["mode_compare"] = f"""with {MODE_RUNS}
select doc_id, max(input_tokens) filter (mode='hybrid') hybrid_tokens,
       max(overall_confidence) filter (mode='hybrid') hybrid_confidence,
       max(input_tokens) filter (mode='text_only') text_only_tokens,
       max(overall_confidence) filter (mode='text_only') text_only_confidence from runs group by doc_id"""
    sql["token_usage"] = f"""with {MODE_RUNS}
select model, mode, count(*)::bigint extractions, sum(input_tokens)::bigint input_tokens,
       sum(output_tokens)::bigint output_tokens, sum(input_tokens)::bigint / count(*) mean_input_tokens
from runs group by model, mode"""
    sql["judge_token_usage"] = f"""with {JUDGE_ROWS}
select metric, sum(n_chars // 4)::bigint prompt_tokens, sum(doc_id % 50 + 10)::bigint completion_tokens,
       sum(n_chars // 4 + doc_id % 50 + 10)::bigint total_tokens from judge group by metric"""
    sql["report"] = f"""with recursive {ground}, confident as ({confidence_of(DEFAULT_WEIGHTS)})
select doc_id, 'invoice' document_type, document_number, coalesce(document_date, 'N/A') document_date, amount,
       'USD' currency, overall_confidence, format('{DOT1}%', overall_confidence * 100::double) confidence_text,
       high_confidence, medium_confidence, low_confidence, n_items::bigint n_items
from confident join invoices using (doc_id)"""
    sql["line_item_listing"] = f"""with {INVOICES}
select doc_id, item::int item, substr(description, 1, 40) || '...' description, total from items"""
    sql["score_bands"] = f"""with recursive {ground}, confident as ({confidence_of(DEFAULT_WEIGHTS)})
select doc_id, field,
       case when confidence >= 0.9 then 'high' when confidence >= 0.5 then 'medium' else 'low' end field_band,
       case when overall_confidence >= 0.9 then 'excellent' when overall_confidence >= 0.8 then 'good'
            when overall_confidence >= 0.7 then 'fair' else 'poor' end overall_band
from comparison join confident using (doc_id)"""
    sql["document_results"] = flow()
    sql["result_export"] = flow()
    sql["bucketed_results"] = flow()
    sql["custom_flow"] = custom_flow()
    return sql
