"""DuckDB text of the stand-in domain views (same rows as campusflow/sources/fixtures.py).

``with_views(body)`` prefixes a query with the CTEs it refers to, so every
oracle query reads the driver's pre-registered test tables directly.
"""

from __future__ import annotations

import re

AS_OF_SQL = "timestamp '1998-06-01 12:00:00'"


def _hhmm(m: str) -> str:
    return (
        f"concat(lpad(cast(cast(floor({m} / 60) as int) as varchar), 2, '0'), ':', "
        f"lpad(cast(cast({m} % 60 as int) as varchar), 2, '0'), ':00')"
    )


def _typed(text: str, loose: int, odd: int) -> str:
    short = f"replace(regexp_replace({text}, '([- :])0', '\\1', 'g'), ' ', '  ')"
    return f"(case when src_id % {loose} = 0 then {short} when src_id % {odd} = 0 then {text} || ' ' else {text} end)"


# Ordered: each view may use the ones above it.
VIEWS: dict[str, str] = {
    "d_venues": """
        select p_partkey as id, p_name as name, p_brand as building, cast(p_size * 10 as int) as capacity,
               cast(case when p_partkey % 4 <> 3 then 1 else 0 end as int) as is_available
        from part""",
    "d_hosts": """
        select s_suppkey as id, s_name as name,
               concat('h', cast(s_suppkey - s_suppkey % 7 as int), '@example.org') as email,
               case when s_suppkey % 3 = 0 then null else concat('555', cast(s_suppkey as int)) end as phone,
               n_name as department,
               case when s_suppkey % 2 = 0 then 'Professor' else 'Staff' end as role
        from supplier join nation on s_nationkey = n_nationkey""",
    "d_students": """
        select c_custkey as id, c_name as srn, concat(c_mktsegment, ' ', cast(c_custkey as int)) as name,
               cast(c_custkey % 10 as int) as semester,
               substr('ABCDEF', cast(c_custkey % 6 as int) + 1, 1) as section
        from customer""",
    "d_events": """
        select o_orderkey as id, concat('Event ', cast(o_orderkey % 300 as int)) as name,
               o_orderpriority as description, cast(o_orderdate as date) as date,
               o_orderdate + to_minutes(480 + (o_orderkey * 37) % 600) as start_ts,
               o_orderdate + to_minutes(510 + (o_orderkey * 37) % 600 + (o_orderkey * 53) % 180) as end_ts,
               case when o_orderkey % 50 = 0 then null else (o_orderkey * 7) % 40 end as location_id,
               cast(case when o_orderkey % 97 = 0 then 999999999 else o_custkey % 10 end as bigint) as organizer_id,
               o_orderstatus as status, cast(20 + o_orderkey % 400 as int) as max_participants
        from orders""",
    "d_li": """
        select *, l_orderkey * 10 + l_linenumber + (row_number() over (partition by l_orderkey, l_linenumber
               order by l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate) - 1) * 100000000000 as line_id
        from lineitem""",
    "d_tickets": """
        select line_id as id, l_orderkey as event_id, l_returnflag as ticket_type,
               cast(case when l_linenumber = 1 then 0.0 else l_extendedprice end as double) as price,
               cast(l_quantity as int) - 1 as quantity
        from d_li""",
    "d_tickets_unset": """
        select id, event_id, ticket_type, price,
               case when event_id % 11 = 3 and id % 10 = 5 then null else quantity end as quantity
        from d_tickets""",
    "d_bookings": """
        select id, event_id, resource_id, quantity_booked, booking_start,
               booking_start + to_minutes(30 + (l_orderkey * 53) % 2880) as booking_end
        from (select line_id as id, l_orderkey as event_id, l_suppkey as resource_id,
                     cast(l_quantity as int) % 5 + 1 as quantity_booked, l_orderkey,
                     l_shipdate + to_minutes(480 + (l_orderkey * 37 + l_linenumber * 11) % 600) as booking_start
              from d_li where l_linenumber <> 7 or l_returnflag <> 'R')""",
    "d_maintenance": """
        select line_id as id, l_suppkey as resource_id, l_shipdate as maintenance_start,
               l_shipdate + to_minutes(60 + (l_orderkey * 53) % 4320) as maintenance_end, l_returnflag as description
        from d_li where l_linenumber = 7 and l_returnflag = 'R'""",
    "d_resources": """
        select s_suppkey as id, s_name as name,
               case when s_suppkey % 2 = 0 then 'AV Equipment' else 'Furniture' end as type,
               cast(4 + s_suppkey % 5 as int) as quantity,
               concat('Resource ', cast(s_suppkey as int)) as description,
               cast(case when s_suppkey % 9 = 0 then 0 else 1 end as int) as is_available,
               case when s_suppkey % 9 = 0 then 'Under Maintenance' when s_suppkey % 9 = 1 then 'AVAILABLE'
                    else 'Available' end as maintenance_status
        from supplier""",
    "d_act": """
        select *, cast(floor(event_id / 20) as bigint) as ev,
               case when event_id % 101 = 0 then user_id + 1000000000 else user_id end as user_ref
        from events""",
    "d_participants": """
        select ev as event_id, user_ref as user_id, ts as registration_time,
               cast(case when event_id % 13 = 0 then null when event_type in ('view', 'signup') then 0 else 1 end as int)
                 as attendance_status
        from (select *, row_number() over (partition by ev, user_ref order by ts, event_id) as rn
              from d_act where event_type <> 'error' and (ev + user_ref) % 3 <> 0) where rn = 1""",
    "d_feedback": """
        select event_id as id, ev as event_id, user_id, cast(floor(value) as int) % 6 as rating,
               case when event_id % 3 = 0 then null else props end as comments, ts as submitted_at
        from d_act where event_type in ('view', 'click', 'signup')""",
    "d_orders": """
        select event_id as order_id, ev * 10 + 1 + event_id % 7 as ticket_id, user_id, ts as order_time,
               case when event_type = 'purchase' then 'Completed' else 'Pending' end as payment_status
        from d_act where event_type in ('purchase', 'click')""",
    "d_order_once": """
        select event_id as request_id, ts as request_ts, user_ref as user_id, ev as event_id,
               ev * 10 + 1 + event_id % 7 as ticket_id,
               cast(case when event_id % 83 = 0 then 0 else 1 + event_id % 6 end as int) as how_many,
               cast(case when event_type = 'error' then 0 else 1 end as int) as paid
        from d_act""",
    "d_order_requests": """
        select * from d_order_once
        union all
        select request_id + 1000000000, request_ts + to_minutes(1), user_id, event_id, ticket_id, how_many, paid
        from d_order_once where request_id % 5 = 0""",
    "d_order_request_texts": """
        select request_id, request_ts, user_id, event_id, ticket_id,
               case when request_id % 43 = 0 then 'two' when request_id % 41 = 0 then '1.5'
                    when request_id % 37 = 0 then '' when request_id % 31 = 0 then null
                    when request_id % 29 = 0 then concat(' ', how_many, ' ')
                    else cast(how_many as varchar) end as how_many,
               case when paid = 0 then 'n' when request_id % 3 = 0 then ' Y ' else 'y' end as paid
        from d_order_requests""",
    "d_cancel_requests": """
        select event_id as request_id, ts as request_ts,
               case when event_id % 89 = 0 then user_id + 500000000 else user_id end as user_id, ev as event_id
        from d_act where event_type = 'purchase'""",
    "d_event_requests": f"""
        select request_id, request_ts, name, description, date_text,
               case when event_id % 53 = 0 then '25:61:00' else {_hhmm('_sm')} end as start_text,
               case when event_id % 31 = 0 then concat(' ', cast(floor(_em / 60) as int), ':', cast(_em % 60 as int), ':0')
                    else {_hhmm('_em')} end as end_text, organizer_id, location_id, max_participants
        from (select event_id, event_id as request_id, ts as request_ts,
                     concat('Proposal ', cast(event_id as varchar)) as name, props as description,
                     cast(date '1998-06-01' + cast(event_id % 30 as int) as varchar) as date_text,
                     480 + (event_id * 37) % 600 as _sm,
                     case when event_id % 17 = 0 then 480 + (event_id * 37) % 600 - 30
                          else 480 + (event_id * 37) % 600 + 30 + (event_id * 53) % 180 end as _em,
                     cast(case when event_id % 29 = 0 then 999999999 else user_id % 10 end as bigint) as organizer_id,
                     (user_id * 3 + event_id) % 40 as location_id,
                     cast(10 + (event_id * 13) % 500 as int) as max_participants
              from d_act where event_type = 'signup')""",
    "d_event_update_requests": f"""
        select request_id, request_ts, event_id, kind, new_name, new_description, new_date_text,
               case when src_id % 47 = 0 then 'noon'
                    when src_id % 23 = 0 then concat(cast(floor(_sm / 60) as int), ':', cast(_sm % 60 as int), ':0')
                    else {_hhmm('_sm')} end as new_start_text,
               {_hhmm('_em')} as new_end_text, new_location_id
        from (select event_id as src_id, event_id as request_id, ts as request_ts,
                     case when event_id % 67 = 0 then ev + 1000000000 else ev end as event_id,
                     cast(case when event_id % 61 = 0 then 9 else 1 + event_id % 3 end as int) as kind,
                     case when event_id % 4 = 0 then '' else concat('Renamed ', cast(event_id as varchar)) end as new_name,
                     case when event_id % 5 = 0 then '' else props end as new_description,
                     case when event_id % 6 = 0 then ''
                          else cast(date '1998-06-01' + cast(event_id % 30 as int) as varchar) end as new_date_text,
                     480 + (event_id * 41) % 600 as _sm,
                     case when event_id % 19 = 0 then 480 + (event_id * 41) % 600
                          else 480 + (event_id * 41) % 600 + 30 + (event_id * 29) % 180 end as _em,
                     (user_id * 11) % 40 as new_location_id
              from d_act where event_type = 'click')""",
    "d_booking_requests": f"""
        select request_id, request_ts, event_id, resource_id, quantity,
               {_typed("cast(_st as varchar)", 37, 41)} as start_text,
               case when src_id % 47 = 0 then 'soon'
                    when src_id % 19 = 0 then cast(_st as varchar)
                    else cast(_st + to_minutes(30 + (src_id * 53) % 2880) as varchar) end as end_text
        from (select event_id as src_id, event_id as request_id, ts as request_ts,
                     case when event_id % 71 = 0 then ev + 1000000000 else ev end as event_id,
                     user_id as resource_id, cast(floor(value) as int) % 9 - 1 as quantity,
                     timestamp '1997-06-01 00:00:00' + to_minutes((event_id % 60) * 1440 + (event_id * 41) % 1440) as _st
              from d_act where event_type = 'view')""",
    "d_maintenance_requests": f"""
        select request_id, request_ts, resource_id,
               case when src_id % 59 = 0 then '1997-13-45 00:00:00'
                    else {_typed("cast(_st as varchar)", 37, 41)} end as start_text,
               case when src_id % 23 = 0 then cast(_st + to_minutes(-60) as varchar)
                    else cast(_st + to_minutes(60 + (src_id * 31) % 4320) as varchar) end as end_text,
               description
        from (select event_id as src_id, event_id as request_id, ts as request_ts, user_id as resource_id,
                     props as description,
                     timestamp '1997-06-01 00:00:00' + to_minutes((event_id % 60) * 1440 + (event_id * 29) % 1440) as _st
              from d_act where event_type = 'error')""",
    "d_ticket_requests": """
        select event_id as request_id, ts as request_ts,
               cast(case when event_id % 4 = 0 then 1 else 2 end as int) as kind, ev as event_id,
               case when event_id % 4 = 0 then null when event_id % 13 = 0 then (ev + 1) * 10 + 1
                    else ev * 10 + 1 + event_id % 8 end as ticket_id,
               case when event_id % 4 = 0 then 'Early Bird' else null end as ticket_type,
               cast(case when event_id % 4 = 0 then value else null end as double) as price,
               cast(case when event_id % 4 = 0 then cast(floor(value) as int) % 50 else null end as int) as quantity,
               cast(case when event_id % 3 = 0 then null when event_id % 3 = 1 then value else -1.0 end as double) as new_price,
               cast(case when event_id % 5 = 0 then null else cast(floor(value) as int) % 60 - 5 end as int) as new_quantity
        from d_act where event_type = 'click'""",
    "d_attendance_requests": """
        select event_id as request_id, ts as request_ts,
               case when event_id % 53 = 0 then ev + 1000 else ev end as event_id, user_id
        from d_act where event_type = 'view'""",
    "d_venue_flag_requests": """
        select event_id as request_id, ts as request_ts, user_id * 20 as venue_id,
               cast(event_id % 3 as int) as new_status
        from d_act where event_type = 'purchase'""",
    "d_resource_status_requests": """
        select event_id as request_id, ts as request_ts, user_id as resource_id,
               case event_id % 5 when 0 then 'Available' when 1 then 'available' when 2 then 'Under Maintenance'
                    when 3 then 'Damaged' else 'AVAILABLE ' end as new_status
        from d_act where event_type = 'click'""",
    "d_student_requests": """
        select event_id as request_id, ts as request_ts,
               case when event_id % 9 = 0 then concat('Customer#', lpad(cast(user_id as varchar), 9, '0'))
                    else concat('SRN', cast((event_id * 7) % 1000 as varchar)) end as srn,
               concat('Student ', cast(event_id as varchar)) as name,
               cast(event_id % 10 as int) as semester, 'A' as section
        from d_act where event_type = 'signup'""",
    "d_host_requests": """
        select event_id as request_id, ts as request_ts, concat('Host ', cast(event_id as varchar)) as name,
               concat('h', cast(user_id % 30 as varchar), '@example.org') as email,
               case when event_id % 4 = 0 then '' else concat('555', cast(user_id % 50 + 90 as varchar)) end as phone,
               case when event_id % 2 = 0 then 'Professor' else 'Staff' end as role,
               case when event_id % 5 = 0 then '' else 'CSE' end as department
        from d_act where event_type = 'error'""",
    "d_resource_requests": """
        select event_id as request_id, ts as request_ts, concat('Projector ', cast(event_id as varchar)) as name,
               'AV Equipment' as type, cast(floor(value) as int) % 12 - 2 as quantity, props as description
        from d_act where event_type = 'signup'""",
    "d_feedback_requests": """
        select event_id as request_id, ts as request_ts, user_id, ev as event_id,
               cast(floor(value) as int) % 7 as rating,
               case when event_id % 4 = 0 then '' else props end as comments
        from d_act where event_type in ('purchase', 'click')""",
}


def _deps(text: str) -> set[str]:
    return {name for name in VIEWS if re.search(rf"\b{name}\b", text)}


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs it (transitively) refers to, in order."""
    needed: set[str] = set()
    frontier = _deps(body)
    while frontier:
        name = frontier.pop()
        if name in needed:
            continue
        needed.add(name)
        frontier |= _deps(VIEWS[name]) - needed
    ctes = [f"{name} as ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = body.strip()
    if not ctes:
        return body
    m = re.match(r"with\s+recursive\s+", body, re.IGNORECASE)
    if m:
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[m.end():]
    m = re.match(r"with\s+", body, re.IGNORECASE)
    if m:
        return "with " + ",\n".join(ctes) + ",\n" + body[m.end():]
    return "with " + ",\n".join(ctes) + "\n" + body
