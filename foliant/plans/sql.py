"""SQL forms of the adapted tables, as common table expressions in DuckDB's dialect."""

from foliant.sources.adapters import EXCEPTIONS, FIELDS, TYPES


def pick(values: list[str], key: str) -> str:
    items = ",".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[cast(({key}) % {len(values)} + 1 as integer)]"


def names(values) -> str:
    return ",".join("'" + v.replace("'", "''") + "'" for v in values)


DM = f"""dm as (select 'doc_' || event_id as document_id, {pick(TYPES, 'user_id')} as document_type,
  case when event_type in ('purchase','view') then 'success' when event_type='signup' then 'needs_review'
       when event_type='click' then 'reprocessing' else 'failed' end as processing_status,
  ts as start_time, ts + to_microseconds(cast(round(value*1000000) as bigint)) as end_time, value as total_processing_time,
  cast(event_id % 14 + 1 as integer) as field_count, event_type='signup' as hitl_required,
  case when event_type='error' then {pick(EXCEPTIONS, 'event_id')} end as exception_type,
  event_id % 97 <> 0 as has_cost, greatest(0.001, value*0.0001) as compute, 0.0001::double as storage,
  case when event_type='signup' then 0.05 else 0.0 end::double as review,
  (50 + event_id % 50)/100.0::double as overall, ts as created_at, event_id from events)"""

FM = f"""fm as (select {pick(FIELDS, 'event_id')} as field_name, {pick(TYPES, 'user_id')} as document_type, (60+event_id%40)/100.0::double as precision,
  (60+(event_id*3)%40)/100.0::double as recall, (60+(event_id*7)%40)/100.0::double as accuracy,
  2*((60+event_id%40)/100.0::double)*((60+(event_id*3)%40)/100.0::double)/((60+event_id%40)/100.0::double+(60+(event_id*3)%40)/100.0::double) as f1_score,
  (50+event_id%50)/100.0::double as confidence_avg, ts as created_at, event_id as metric_id from events)"""

PERIOD = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")
AS_OF = "2024-01-30 12:00:00"
IN_PERIOD = f"start_time between timestamp '{PERIOD[0]}' and timestamp '{PERIOD[1]}'"
PDM = f"{DM}, p as (select * from dm where {IN_PERIOD})"


def quantiles(source: str, group: str | None, value: str = "t") -> str:
    """CTE ``qt`` with p50 and the exclusive p95 of the positive values per group."""
    part = f"partition by {group}" if group else ""
    g = f"{group}," if group else ""
    by = f"group by {group}" if group else ""
    return f"""qr as (select {g} {value} as t, row_number() over ({part} order by {value}) k, count(*) over ({part}) n from {source} where {value} > 0),
  qj as (select *, greatest(least(19*(n+1)//20, n-1), 1) j from qr),
  qt as (select {g} avg(case when k in ((n+1)//2, n//2+1) then t end) as latency_p50,
    case when max(n) >= 20 then sum(case when k=j then t*(20-(19*(n+1)-20*j)) when k=j+1 then t*(19*(n+1)-20*j) else 0 end)/20 else max(t) end as latency_p95
    from qj {by})"""


QUALITY = """coalesce(avg(case when processing_status='success' then 1.0 else 0.0 end),0.0)::double as overall_accuracy,
  coalesce(avg(case when not hitl_required then 1.0 else 0.0 end),0.0)::double as stp_rate,
  coalesce(avg(case when exception_type is not null then 1.0 else 0.0 end),0.0)::double as exception_rate"""
HOURS = "greatest((epoch_us(max(start_time)) - epoch_us(min(start_time)))/3600000000.0, 1.0)"
THROUGHPUT = f"case when count(*) filter (total_processing_time > 0) > 0 then count(*) / {HOURS} else 0.0 end::double as throughput_docs_per_hour"
SLA = "coalesce(avg(case when total_processing_time<=300 then 1.0 else 0.0 end) filter (total_processing_time>0),0.0)::double as sla_adherence_rate"
COST = """coalesce(avg(case when has_cost then compute+storage+review end),0.0)::double as cost_per_document,
  coalesce(avg(case when has_cost then compute end),0.0)::double as compute_cost_per_doc,
  coalesce(avg(case when has_cost then storage end),0.0)::double as storage_cost_per_doc,
  coalesce(avg(case when has_cost then review end),0.0)::double as review_cost_per_doc"""
REWORK = """coalesce(avg(case when processing_status='reprocessing' then 1.0 else 0.0 end),0.0)::double as reprocess_rate,
  count(*) filter (exception_type='poison_queue') as poison_queue_count"""

RT = f"""rt as (select 'TASK-'||o_orderkey as task_id, 'doc_'||(o_orderkey*3) as document_id, {pick(TYPES[:5], 'o_custkey')} as document_type,
  o_orderkey as key, o_orderdate + to_seconds(o_orderkey % 86400) as created_at,
  case when o_orderstatus='F' then case when o_orderkey%10=0 then 'approved' else 'completed' end
       when o_orderstatus='O' then {pick(['pending', 'assigned'], 'o_orderkey')} else 'in_progress' end as status,
  cast(cast(left(o_orderpriority,1) as integer) % 3 + 1 as integer) as priority,
  cast(o_totalprice as decimal(18,2)) as total, o_custkey,
  case when o_orderkey%4=0 then 1 else 0 end as errors,
  {pick(['low_confidence', 'validation_error', 'missing_required_field', 'business_rule_violation', 'manual_review'], 'o_orderkey')} as reason,
  (30 + o_orderkey%70)/100.0::double as confidence_score from orders),
tasks as (select *, case when status<>'pending' then 'rev_'||(key%50) end as assigned_to,
  case when (status in ('completed','approved') and key%20<>1) or status='in_progress' then created_at + to_minutes(key%240) end as first_touched_at,
  case when status in ('completed','approved') then created_at + to_minutes(key%240+30+key%77) end as resolution_time from rt)"""
TASKS_AS_OF = "1998-06-30 00:00:00"

OD = f"""od0 as (select o_orderkey as key, 'DOC-'||o_orderkey as document_id,
  {pick(['invoice', 'invoice', 'invoice', 'receipt', 'contract', 'general_document', 'custom'], 'o_orderkey')} as document_type,
  cast(o_totalprice as decimal(18,2)) as t, round(cast(o_totalprice as decimal(18,2))*0.08, 2)::decimal(18,2) as tax,
  cast(o_orderdate as date) as doc_date, cast(o_orderdate as date) + cast(o_orderkey%45 - 5 as integer) as due_date,
  o_custkey as party, o_orderstatus, o_orderpriority from orders),
od as (select *, (t - tax)::decimal(18,2) as subtotal, (case when key%7=0 then t+1 else t end)::decimal(18,2) as total from od0)"""


def _usd(c: str) -> str:
    return f"'$'||format('{{:,.2f}}', {c}::double)"


def _mdy(c: str) -> str:
    return f"strftime({c}, '%-m/%-d/%Y')"


_NL = "||chr(10)||"
_PARTY = "'Trader '||party||' Ltd'"
_TEXTS = {
    "invoice": _NL.join([
        "'INVOICE'", f"{pick(['Invoice #: INV-', 'Inv #: INV-', 'Bill Number: INV-', 'Reference: INV-'], 'key')}||key",
        f"{pick(['From: ', 'Seller: ', 'Bill From: '], 'key')}||{_PARTY}",
        f"{pick(['Date: ', 'Bill Date: ', 'Issued '], 'key')}||(case when key%4=3 then doc_date::varchar else {_mdy('doc_date')} end)",
        f"{pick(['Payment Due: ', 'Due: '], 'key')}||{_mdy('due_date')}", f"{pick(['Sub Total: ', 'Net Amount: '], 'key')}||{_usd('subtotal')}",
        f"{pick(['Sales Tax: ', 'VAT: ', 'Tax (8.0%): '], 'key')}||{_usd('tax')}",
        f"{pick(['Grand Total: ', 'Amount Due: ', 'Balance: ', 'Pay '], 'key')}||{_usd('total')}", "'Customer: C-'||party", "'Payment terms apply. Thank you'"]),
    "receipt": _NL.join([
        f"{pick(['Store: ', 'Shop: '], 'key')}||{_PARTY}", f"'Purchase Date: '||{_mdy('doc_date')}", f"'Total: '||{_usd('total')}",
        f"'Paid by: '||{pick(['Visa', 'Cash', 'Voucher'], 'key')}", "'Thank you for your transaction'"]),
    "contract": _NL.join([
        "'Agreement Title: Supply contract '||key", f"'Between: '||{_PARTY}||' and Buyer '||party", f"'Effective Date: '||{_mdy('doc_date')}",
        f"'Expires: '||{_mdy('due_date')}", f"'Consideration: '||{_usd('total')}", f"'Governed by: Law '||{pick(['A', 'B'], 'key')}",
        "'terms and conditions and signature of each party'"]),
    "general_document": _NL.join([
        "'Subject: Report '||key", f"'Prepared by: '||{_PARTY}", f"'Created: '||{_mdy('doc_date')}",
        "'Body: analysis and findings with a conclusion in the executive summary of account '||key", "'Page Count: '||(key%30)"]),
    "custom": _NL.join(["'Note '||key||' dated '||strftime(doc_date, '%B %-d, %Y')", f"'value of '||{_usd('total')}||' and '||{_usd('tax')}"]),
}
TX = OD + ", tx as materialized (select *, case document_type " + " ".join(
    f"when '{k}' then {v}||chr(10)" for k, v in _TEXTS.items()) + " end as full_text from od)"

FD = OD + """, fd as (select key, document_id, document_type,
  case when key%13=0 then '' when key%5=0 then 'INV/!' else 'INV-'||key end as invoice_number, doc_date::varchar as invoice_date,
  case when key%17=0 then 'soon' else strftime(due_date,'%-m/%-d/%Y') end as due_date, '$'||total as total_amount, '$'||subtotal as subtotal, '$'||tax as tax_amount,
  case when key%9=0 then 'bad-address' else 'c'||key||'@Example.COM' end as email,
  case when key%8=0 then '12-34' else '(555) 010-'||lpad((key%10000)::varchar,4,'0') end as phone, '4'||lpad(key::varchar,15,'7') as card,
  (['Visa debit','barter','CASH'])[cast(key%3+1 as integer)] as payment_method,
  (50+(key*3)%50)/100.0::double as c_number, (50+(key*7)%50)/100.0::double as c_total, (50+(key*9)%50)/100.0::double as c_vendor, (50+(key*11)%50)/100.0::double as c_date from od),
fv as (unpivot (select key, document_id, document_type, invoice_number, invoice_date, due_date, total_amount, subtotal, tax_amount, email, phone, card, payment_method from fd)
  on invoice_number, invoice_date, due_date, total_amount, subtotal, tax_amount, email, phone, card, payment_method into name field_name value value)"""

EF = f"""ef as (select 'DOC-'||l_orderkey as document_id, {pick(FIELDS, 'l_linenumber')} as field_name, cast(l_extendedprice as decimal(18,2))::varchar as value,
  (50 + l_quantity::bigint)/100.0::double as confidence, l_partkey*100000+l_suppkey*100+l_quantity::bigint as pos, l_returnflag<>'R' as valid,
  case when l_linestatus='O' then 'error' else 'warning' end as severity from lineitem)"""


def luhn(digits: str) -> str:
    """Checksum of a text of digits."""
    return (f"list_sum(list_transform(range(1, length({digits})+1), lambda i: case when i%2=1 then substr(reverse({digits}),i,1)::int "
            f"when substr(reverse({digits}),i,1)::int*2>9 then substr(reverse({digits}),i,1)::int*2-9 else substr(reverse({digits}),i,1)::int*2 end)) % 10")


def to_date(c: str) -> str:
    return f"try_strptime({c}, ['%Y-%m-%d','%m/%d/%Y','%m-%d-%Y','%d/%m/%Y','%d-%m-%Y','%m/%d/%y','%B %d, %Y','%d %B %Y','%Y-%m-%dT%H:%M:%S','%Y-%m-%d %H:%M:%S'])::date"
