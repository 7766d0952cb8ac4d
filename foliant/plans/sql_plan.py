"""The document plan in SQL, put together from the rules of extraction, validation and routing.

One row per field first, then its failed rules, then one row per document with its decision.
"""

from __future__ import annotations

from foliant import config
from foliant.config import DocSchema, FieldSpec
from foliant.plans import sql as Q
from foliant.plans.queries_extract import _FIRST_DATE, _MAXTXT, _TYPED, label_name_sql, label_sql

#: The recognised fields of the adapted documents that a schema names: condition, value and confidence.
_RECOGNISED = {
    "total_amount": ("true", "case when key%3=0 then '$'||total::varchar else '$1.00' end", "(60+case when key%3=0 then (key*3)%40 else key%40 end)/100.0"),
    "vendor_name": ("key%5=0", "'Vendor '||key", "(60+(key*7)%40)/100.0"),
}


def _field(spec: FieldSpec, recognised: bool) -> tuple[str, str]:
    """A field's raw value and its confidence, by the first strategy that has one."""
    third = {"currency": ("contains(full_text,'$')", _MAXTXT, config.CONF_CURRENCY), "date": (f"({_FIRST_DATE}) is not null", _FIRST_DATE, config.CONF_DATE)}.get(spec.field_type)
    ways = [_RECOGNISED[spec.name]] if recognised and spec.name in _RECOGNISED else []
    ways += [(f"{label_name_sql(spec)} is not null", label_sql(spec, 2), config.CONF_LABEL)] + ([third] if third else [])
    return tuple("case " + " ".join(f"when {w[0]} then {w[i]}" for w in ways) + " end" for i in (1, 2))


#: Whether a value passes, by rule, from the normalised value ``z_t``, date ``z_d`` and number ``z_n``.
def _passes(rule: str, as_of: str) -> str | None:
    name, _, arg = rule.partition(":")
    return {
        "not_empty": "trim(z_t)<>''", "min_length": f"z_t<>'' and length(z_t)>={arg or 0}", "max_length": f"z_t='' or length(z_t)<={arg or 0}",
        "alphanumeric": f"z_t<>'' and regexp_matches(z_t,'{config.ALNUM_PATTERN}')", "valid_date": "z_d is not null", "past_date": f"z_d<=date '{as_of}'",
        "future_date": f"z_d>=date '{as_of}'", "positive_amount": "z_n>0", "non_negative_amount": "z_n>=0",
        "currency_format": f"z_t<>'' and regexp_matches(trim(z_t),'{config.CURRENCY_PATTERN}')",
        "valid_payment_method": "z_t<>'' and (" + " or ".join(f"contains(lower(z_t),'{m}')" for m in config.PAYMENT_METHODS) + ")",
    }.get(name)


def _fields(schema: DocSchema, where: str, recognised: bool, as_of: str) -> str:
    out = []
    for f in schema.fields:
        value, confidence = _field(f, recognised)
        rules = [p for r in f.rules if (p := _passes(r, as_of))]
        failed = " + ".join(f"(not coalesce({p},false))::int" for p in rules) or "0"
        out.append(f"""select key, document_id, document_type, '{f.name}' as name, value, confidence, z_d as d, z_n as n, amount, {failed} as failed, {str(f.required).lower()} as required,
          confidence>={f.threshold} as sure from (select *, case when z_d is not null and dated then z_d::varchar when coalesce(amount,0)<>0 then digits else value end as z_t from (
          select *, {Q.to_date('value')} as z_d, regexp_replace(value,'[^0-9.-]','','g') as digits, try_cast(regexp_replace(value,'[^0-9.-]','','g') as double) as z_n,
           {str(f.name in config.NORMALIZED_DATES).lower()} as dated,
           {"try_cast(regexp_replace(value,'[^0-9.-]','','g') as decimal(28,6))" if f.name in config.NORMALIZED_AMOUNTS else "null::decimal(28,6)"} as amount
          from (select *, ({value})::varchar as value, ({confidence})::double as confidence from tx where {where}))) where value is not null""")
    return " union all ".join(out)


def plan_sql(as_of: str, recognised: bool) -> str:
    """Common table expressions up to ``decided``: a row per document with all that routing says. ``recognised``: documents have
    recognised fields and tables."""
    fields = " union all ".join(_fields(s, where, recognised, as_of) for s, where in _TYPED if s.document_type != "id_document")
    wanted = " union all ".join(f"select document_id, '{f.name}' as name from tx where {where}" for s, where in _TYPED for f in s.fields if f.required)
    needed = "case document_type " + " ".join(f"when '{t}' then {s.required_confidence}" for t, s in config.SCHEMAS.items()) + f" else {config.GENERIC.required_confidence} end"
    named = Q.names(config.NAMED_FIELDS)
    table = "key%6<>5" if recognised else "false"
    of = lambda name, what: f"max(case when name='{name}' then {what} end)"
    return f"""{Q.TX}, fields as materialized ({fields}), wanted as ({wanted}),
  lacking as (select w.document_id, count(*) as missing, count(*) filter (w.name in ({named})) as named from wanted w left join fields f on f.document_id=w.document_id and f.name=w.name
    where not coalesce(f.sure,false) group by 1),
  per as (select document_id, count(*) as fields, avg(confidence) as mean, sum(failed) as failed, sum(case when required then failed else 0 end) as errors,
    count(*) filter (name in ({named}) and confidence<{config.NAMED_FIELD_THRESHOLD}) as weak,
    {of('total_amount', 'amount')} as total_amount, {of('subtotal', 'amount')} as sub, {of('tax_amount', 'amount')} as tax, {of('invoice_date', 'd')} as invoiced, {of('due_date', 'd')} as due
    from fields group by 1),
  crossed as (select tx.document_id, tx.document_type, coalesce(p.fields,0) as fields, p.mean, coalesce(p.failed,0) as failed, coalesce(p.errors,0) as errors, coalesce(p.weak,0) as weak,
    coalesce(l.missing,0) as missing, coalesce(l.named,0) as named, {needed}::double as needed,
    (document_type='invoice' and coalesce(p.total_amount<>0 and p.sub<>0 and abs(p.sub+coalesce(p.tax,0)-p.total_amount)>0.01,false))::int
     + (document_type='invoice' and {table} and coalesce(p.sub<>0 and abs(tx.subtotal-p.sub)>0.01,false))::int
     + (document_type='receipt' and {table} and coalesce(p.total_amount<>0 and abs(key%4+1-p.total_amount)>0.01,false))::int as cross_errors,
    (document_type='invoice' and coalesce(p.due<=p.invoiced,false))::int as cross_warnings from tx left join per p using (document_id) left join lacking l using (document_id)),
  scored as (select *, errors+cross_errors as err, case when mean is null then 0.0 else least(1.0,greatest(0.0,mean-0.1*(errors+cross_errors)-0.05*(failed-errors+cross_warnings))) end as conf,
    weak>0 or named>0 as unsure from crossed),
  reviewed as (select *, conf<{config.HITL_THRESHOLD} or missing>0 or err>0 or conf<needed as review from scored),
  decided as (select document_id, document_type, fields::integer as fields, (failed+cross_errors+cross_warnings)::integer as results, round(conf,6) as overall_confidence, review as requires_hitl,
    case when review then case when unsure then 'missing_required_field' when err>0 then 'validation_error' when conf<{config.HITL_THRESHOLD} then 'low_confidence' end end as routing_reason,
    case when review and unsure then 'urgent' when review and (err>0 or conf<{config.HITL_THRESHOLD}) then 'high' else 'normal' end as priority,
    not review and conf>={config.AUTO_APPROVE_THRESHOLD} as auto_approve from reviewed)"""
