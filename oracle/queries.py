"""DuckDB oracle SQL, one per registered query, over the driver's test tables.

names and types match the Spark results.
"""

from __future__ import annotations

from oracle.views import AS_OF_SQL, with_views

A = AS_OF_SQL

_BODIES: dict[str, str] = {
    "available_venues": "select id, name, building, capacity from d_venues where is_available = 1",
    "venues_with_status": """
        select id, name, building, capacity, is_available,
               case when is_available = 1 then 'Available' else 'Not Available' end as status
        from d_venues""",
    "upcoming_events": f"""
        select e.id as event_id, e.name as event_name, cast(e.date as varchar) as date, e.start_ts, v.name as venue_name,
               coalesce(nullif(v.name, ''), 'N/A') as venue_label, h.name as host_name
        from d_events e left join d_venues v on e.location_id = v.id
        join d_hosts h on e.organizer_id = h.id
        where e.end_ts > {A}""",
    "completed_events": f"""
        select e.id as event_id, e.name as event_name, cast(e.date as varchar) as date, e.end_ts, v.name as venue_name,
               coalesce(nullif(v.name, ''), 'N/A') as venue_label, h.name as host_name
        from d_events e left join d_venues v on e.location_id = v.id
        join d_hosts h on e.organizer_id = h.id
        where e.end_ts <= {A}""",
    "students_roster": "select id, srn, name, semester, section from d_students",
    "available_tickets": "select id, event_id, ticket_type, price, quantity from d_tickets where quantity > 0",
    "event_tickets": "select id, event_id, ticket_type, price, quantity from d_tickets",
    "feedback_report": """
        select f.id as feedback_id, f.event_id, s.name as student_name, s.srn, f.rating,
               repeat('⭐', f.rating) as stars, f.comments
        from d_feedback f join d_students s on f.user_id = s.id""",
    "event_directory": "select id, name, cast(date as varchar) as date from d_events",
    "attendance_roster": """
        select p.event_id, s.id as student_id, s.name, s.srn,
               case when p.attendance_status = 1 then 'Yes' else 'No' end as attended
        from d_participants p join d_students s on p.user_id = s.id""",
    "participants_detail": """
        select p.event_id, e.name as event_name, p.user_id, s.name as student_name, s.srn, p.registration_time,
               case when p.attendance_status = 1 then 'Yes' else 'No' end as attended
        from d_participants p join d_events e on p.event_id = e.id join d_students s on p.user_id = s.id""",
    "participant_counts": """
        select p.event_id, e.name, count(p.user_id) as participant_count
        from d_participants p join d_events e on p.event_id = e.id
        group by p.event_id, e.name""",
    "resources_list": "select id, name, type, quantity, maintenance_status from d_resources",
    "hosts_list": "select id, name, department, role from d_hosts",
    "upcoming_registrations": f"""
        select p.user_id, e.id as event_id, e.name as event_name, cast(e.date as varchar) as date, e.start_ts,
               coalesce(nullif(v.name, ''), 'N/A') as venue_label
        from d_participants p join d_events e on p.event_id = e.id
        left join d_venues v on e.location_id = v.id
        where e.end_ts > {A}""",
    "unknown_student_requests": """
        select r.request_id, r.user_id from d_order_requests r
        where not exists (select 1 from d_students s where s.id = r.user_id)""",
}


def all_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in _BODIES.items()}


def register_sql(name: str, body: str) -> None:
    _BODIES[name] = body

TS = "'%Y-%m-%d %H:%M:%S'"
# RE2 has no look-ahead: year 0000 is refused by its own condition.
TS_FORM = r"'[0-9]{4}-[0-9]{1,2}-( [1-9]|[0-9]{1,2})\s+[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}'"


def _whole(text: str) -> str:
    """The whole number that a text names, blanks around it aside, else NULL."""
    return f"(case when regexp_full_match(trim({text}, ' '), '[+-]?[0-9]+') then try_cast(trim({text}, ' ') as int) end)"


def parsed(text: str) -> str:
    """The datetime of a text as the application parses it, else NULL."""
    return (
        f"(case when regexp_full_match({text}, {TS_FORM}) and not starts_with({text}, '0000') "
        f"then try_strptime(regexp_replace(replace({text}, '- ', '-'), '\\s+', ' '), {TS}) end)"
    )


def _span(view: str, cols: str, start: str = "start_text", end: str = "end_text") -> str:
    return f"(select {cols}, {parsed(start)} as start_ts, {parsed(end)} as end_ts from {view})"


def _event_span(view: str, cols: str) -> str:
    return (
        f"(select {cols}, {parsed("(date_text || ' ' || start_text)")} as start_ts, "
        f"{parsed("(date_text || ' ' || end_text)")} as end_ts from {view})"
    )


_BODIES.update({
    "venue_conflicts": """
        select a.location_id, a.id as event_id_a, b.id as event_id_b
        from d_events a join d_events b
          on a.location_id = b.location_id and a.id < b.id and a.start_ts < b.end_ts and a.end_ts > b.start_ts""",
    "event_request_conflicts": f"""
        select r.request_id, r.location_id,
               (select count(*) from d_events e where e.location_id = r.location_id
                  and e.start_ts < r.end_ts and e.end_ts > r.start_ts) as conflicts
        from {_event_span('d_event_requests', 'request_id, location_id')} r
        where r.start_ts < r.end_ts""",
    "booking_maintenance_conflicts": """
        select b.resource_id, b.id as booking_id, m.id as maintenance_id
        from d_bookings b join d_maintenance m on b.resource_id = m.resource_id
          and b.booking_start < m.maintenance_end and b.booking_end > m.maintenance_start""",
    "maintenance_booking_conflicts": f"""
        select r.request_id, r.resource_id,
               (select count(*) from d_bookings b where b.resource_id = r.resource_id
                  and b.event_id in (select id from d_events)
                  and b.booking_start < r.end_ts and b.booking_end > r.start_ts) as conflicts
        from {_span('d_maintenance_requests', 'request_id, resource_id')} r
        where r.start_ts < r.end_ts""",
    "booked_in_slot": f"""
        select r.request_id, r.resource_id,
               cast(coalesce((select sum(b.quantity_booked) from d_bookings b where b.resource_id = r.resource_id
                  and b.booking_start < r.end_ts and b.booking_end > r.start_ts), 0) as bigint) as booked
        from {_span('d_booking_requests', 'request_id, resource_id')} r
        where r.start_ts < r.end_ts""",
    "resource_remaining": f"""
        select x.request_id, x.resource_id, res.quantity as total, x.booked, res.quantity - x.booked as remaining
        from (select r.request_id, r.resource_id,
                     cast(coalesce((select sum(b.quantity_booked) from d_bookings b where b.resource_id = r.resource_id
                        and b.booking_start < r.end_ts and b.booking_end > r.start_ts), 0) as bigint) as booked
              from {_span('d_booking_requests', 'request_id, resource_id')} r
              where r.start_ts < r.end_ts) x
        join d_resources res on res.id = x.resource_id""",
})


def _bad_span(view: str, source: str, id_col: str, s: str, e: str) -> str:
    return (f"select '{source}' as source, {id_col} as row_id, {s} as start_ts, {e} as end_ts from {view} "
            f"where {s} is null or {e} is null or {e} <= {s}")


def _unparse(view: str, source: str, field: str, text: str) -> str:
    return (f"select '{source}' as source, request_id, '{field}' as field from {view} "
            f"where ({text}) is not null and {parsed('(' + text + ')')} is null")


_BODIES.update({
    "invalid_semester": "select id, srn, semester from d_students where semester is null or semester not between 1 and 8",
    "invalid_rating": "select id, event_id, user_id, rating from d_feedback where rating is null or rating not between 1 and 5",
    "invalid_intervals": " union all ".join([
        _bad_span("d_events", "events", "id", "start_ts", "end_ts"),
        _bad_span("d_bookings", "bookings", "id", "booking_start", "booking_end"),
        _bad_span("d_maintenance", "maintenance", "id", "maintenance_start", "maintenance_end"),
        _bad_span(_event_span("d_event_requests", "request_id"), "event_requests", "request_id", "start_ts", "end_ts"),
        _bad_span(_span("d_booking_requests", "request_id"), "booking_requests", "request_id", "start_ts", "end_ts"),
        _bad_span(_span("d_maintenance_requests", "request_id"), "maintenance_requests", "request_id", "start_ts", "end_ts"),
    ]),
    "over_capacity_events": """
        select e.id as event_id, e.location_id, e.max_participants, v.capacity
        from d_events e join d_venues v on e.location_id = v.id where e.max_participants > v.capacity""",
    "requests_bad_ticket": """
        select r.request_id, r.event_id, r.ticket_id from d_order_requests r left join d_tickets_unset t on r.ticket_id = t.id
        where t.id is null or t.event_id <> r.event_id or not coalesce(t.quantity > 0, false)""",
    "typed_order_requests": f"""
        select request_id, request_ts, user_id, event_id, ticket_id, cast({_whole("how_many")} as varchar) as how_many,
               cast(case when lower(trim(paid, ' ')) = 'y' then 1 else 0 end as int) as paid
        from d_order_request_texts where how_many is null or {_whole("how_many")} is not null""",
    "order_request_rejects": f"""
        select request_id, 'how_many' as "column", how_many as value from d_order_request_texts
        where how_many is not null and {_whole("how_many")} is null""",
    "attendance_roster_order": """
        select p.event_id, s.id as student_id, s.name,
               row_number() over (partition by p.event_id order by s.name, s.id) as position
        from d_participants p join d_students s on p.user_id = s.id""",
    "completed_events_order": f"""
        select e.id, row_number() over (order by e.date desc, e.end_ts desc, e.id) as position
        from d_events e join d_hosts h on h.id = e.organizer_id where e.end_ts <= {AS_OF_SQL}""",
    "participant_counts_order": """
        select event_id, participant_count, row_number() over (order by participant_count desc, event_id) as position
        from (select p.event_id, count(p.user_id) as participant_count
              from d_participants p join d_events e on p.event_id = e.id group by p.event_id)""",
    "event_directory_order": """
        select id, name, row_number() over (order by date desc, id) as position from d_events""",
    "upcoming_events_order": f"""
        select e.id, row_number() over (order by e.date, e.start_ts, e.id) as position
        from d_events e join d_hosts h on h.id = e.organizer_id where e.end_ts > {AS_OF_SQL}""",
    "unfillable_requests": """
        select r.request_id, r.ticket_id, r.how_many, t.quantity from d_order_requests r join d_tickets t on r.ticket_id = t.id
        where t.event_id = r.event_id and t.quantity > 0 and (r.how_many <= 0 or r.how_many > t.quantity)""",
    "invalid_booking_quantity": """
        select * from (
          select r.request_id, r.resource_id, r.quantity, s.quantity as total,
                 case when r.quantity is null or r.quantity > s.quantity then 'OVER_TOTAL'
                      when r.quantity <= 0 then 'NON_POSITIVE' end as reason
          from d_booking_requests r join d_resources s on r.resource_id = s.id) where reason is not null""",
    "invalid_resource_quantity": """
        select request_id, name, quantity from d_resource_requests where quantity is null or quantity < 0""",
    "invalid_flags": """
        select request_id, new_status from d_venue_flag_requests where new_status is null or new_status not in (0, 1)""",
    "duplicate_keys": """
        select 'srn' as key_name, srn as key_value, count(*) as n from d_students where srn is not null group by srn having count(*) > 1
        union all
        select 'email', email, count(*) from d_hosts where email is not null group by email having count(*) > 1
        union all
        select 'phone', phone, count(*) from d_hosts where phone is not null group by phone having count(*) > 1
        union all
        select 'registration', k, count(*) from (select cast(event_id as varchar) || '/' || cast(user_id as varchar) as k
                                                 from d_participants) group by k having count(*) > 1""",
    "orphan_rows": """
        select 'participants' as table_name, cast(event_id as varchar) || '/' || cast(user_id as varchar) as row_key,
               'student' as missing_ref, user_id as ref_id
          from d_participants where user_id not in (select id from d_students)
        union all
        select 'participants', cast(event_id as varchar) || '/' || cast(user_id as varchar), 'event', event_id
          from d_participants where event_id not in (select id from d_events)
        union all
        select 'feedback', cast(id as varchar), 'student', user_id from d_feedback where user_id not in (select id from d_students)
        union all
        select 'feedback', cast(id as varchar), 'event', event_id from d_feedback where event_id not in (select id from d_events)
        union all
        select 'bookings', cast(id as varchar), 'event', event_id from d_bookings where event_id not in (select id from d_events)
        union all
        select 'bookings', cast(id as varchar), 'resource', resource_id from d_bookings
          where resource_id not in (select id from d_resources)
        union all
        select 'orders', cast(order_id as varchar), 'ticket', ticket_id from d_orders where ticket_id not in (select id from d_tickets)
        union all
        select 'orders', cast(order_id as varchar), 'student', user_id from d_orders where user_id not in (select id from d_students)""",
    "requests_bad_venue": """
        select request_id, location_id from d_event_requests
        where location_id not in (select id from d_venues where is_available = 1) or location_id is null""",
    "unparseable_requests": " union all ".join([
        _unparse("d_event_requests", "event_requests", "date_text+start_text", "date_text || ' ' || start_text"),
        _unparse("d_event_requests", "event_requests", "date_text+end_text", "date_text || ' ' || end_text"),
        _unparse("d_event_update_requests", "event_update_requests", "new_date_text+new_start_text",
                 "new_date_text || ' ' || new_start_text"),
        _unparse("d_event_update_requests", "event_update_requests", "new_date_text+new_end_text",
                 "new_date_text || ' ' || new_end_text"),
        _unparse("d_booking_requests", "booking_requests", "start_text", "start_text"),
        _unparse("d_booking_requests", "booking_requests", "end_text", "end_text"),
        _unparse("d_maintenance_requests", "maintenance_requests", "start_text", "start_text"),
        _unparse("d_maintenance_requests", "maintenance_requests", "end_text", "end_text"),
    ]),
    "lowest_ticket": "select event_id, min(id) as ticket_id from d_tickets group by event_id",
    "first_feedback": """
        select event_id, user_id, submitted_at, id, rating from (
          select f.*, row_number() over (partition by f.event_id, f.user_id order by f.submitted_at, f.id) as rn
          from d_feedback f
          where exists (select 1 from d_participants p where p.event_id = f.event_id and p.user_id = f.user_id
                          and coalesce(p.attendance_status, 1) <> 0)) where rn = 1""",
})

UPCOMING = f"exists (select 1 from d_events ue join d_hosts uh on ue.organizer_id = uh.id where ue.end_ts > {A})"
COMPLETED = f"exists (select 1 from d_events ce join d_hosts ch on ce.organizer_id = ch.id where ce.end_ts <= {A})"


def _before(f_ts: str, f_id: str, ts: str, id_: str) -> str:
    return f"({f_ts} < {ts} or ({f_ts} = {ts} and {f_id} < {id_}))"


def _last(src: str, keys: str, cols: str) -> str:
    return (f"(select {keys}, {cols} from (select *, row_number() over (partition by {keys} "
            f"order by request_ts desc, request_id desc) as rn from {src}) where rn = 1)")


_CANCEL = f"""
    c as (select r.*,
            exists (select 1 from d_participants p where p.event_id = r.event_id and p.user_id = r.user_id) as reg,
            row_number() over (partition by r.event_id, r.user_id order by r.request_ts, r.request_id) as k,
            exists (select 1 from d_events e where e.id = r.event_id and e.end_ts > {A}) as up
          from d_cancel_requests r),
    u0 as (select p.user_id, count(*) as u0 from d_participants p join d_events e on p.event_id = e.id
           where e.end_ts > {A} group by p.user_id),
    g as (select c.*, (reg and k = 1) as cand from c),
    h as (select g.*, coalesce(sum(case when cand and up then 1 else 0 end) over (partition by user_id
            order by request_ts, request_id rows between unbounded preceding and 1 preceding), 0) as before from g),
    cd as (select h.request_id, h.user_id, h.event_id,
             case when coalesce(u0.u0, 0) - h.before <= 0 then 'NO_UPCOMING' when not h.cand then 'NOT_REGISTERED' end
               as reason
           from h left join u0 on h.user_id = u0.user_id),
    done as (select event_id, user_id from cd where reason is null)"""

_ATTEND = """
    ad as (select r.request_id, r.event_id, r.user_id,
             case when not exists (select 1 from d_events) then 'EMPTY_LIST'
                  when not exists (select 1 from d_participants p join d_students s on p.user_id = s.id
                                   where p.event_id = r.event_id) then 'NO_REGISTRATIONS'
                  when not exists (select 1 from d_participants p where p.event_id = r.event_id
                                   and p.user_id = r.user_id) then 'NOT_REGISTERED' end as reason
           from d_attendance_requests r)"""

_VFLAG = """
    vd as (select r.request_id, r.request_ts, r.venue_id, r.new_status,
             case when r.new_status is null or r.new_status not in (0, 1) then 'INVALID_STATUS'
                  when not exists (select 1 from d_venues v where v.id = r.venue_id) then 'UNKNOWN_VENUE' end as reason
           from d_venue_flag_requests r)"""

_RSTATUS = """
    rd as (select r.request_id, r.request_ts, r.resource_id, r.new_status,
             case when lower(r.new_status) = 'available' then 1 else 0 end as is_available,
             case when not exists (select 1 from d_resources) then 'EMPTY_LIST'
                  when not exists (select 1 from d_resources s where s.id = r.resource_id) then 'UNKNOWN_RESOURCE' end
               as reason
           from d_resource_status_requests r)"""

_MAINT = f"""
    mr as (select request_id, resource_id, description, {parsed('start_text')} as s,
                  {parsed('end_text')} as e from d_maintenance_requests),
    mc as (select mr.*, case when s < e then (select count(*) from d_bookings b where b.resource_id = mr.resource_id
                  and b.event_id in (select id from d_events) and b.booking_start < mr.e and b.booking_end > mr.s) end
                  as conflicts from mr),
    md as (select mc.*, case when not exists (select 1 from d_resources) then 'EMPTY_LIST'
                  when s is null or e is null then 'UNPARSEABLE' when e <= s then 'BAD_TIME'
                  when conflicts > 0 then 'BOOKED'
                  when not exists (select 1 from d_resources x where x.id = mc.resource_id) then 'UNKNOWN_RESOURCE' end
                  as reason from mc)"""

_FEEDBACK = f"""
    fg as (select r.*,
             (select min(coalesce(p.attendance_status, 1)) from d_participants p
               where p.event_id = r.event_id and p.user_id = r.user_id) as attend,
             exists (select 1 from d_feedback f where f.event_id = r.event_id and f.user_id = r.user_id) as given,
             exists (select 1 from d_students s where s.id = r.user_id) as student,
             exists (select 1 from d_events e where e.id = r.event_id) as known_event,
             (exists (select 1 from d_students) and {COMPLETED}) as gate
           from d_feedback_requests r),
    fs as (select fg.*, case when not gate then 'EMPTY_LIST' when attend is null then 'NOT_PARTICIPANT'
                  when attend = 0 then 'NOT_ATTENDED' when given then 'ALREADY_GIVEN' end as static_reason,
                  (rating is null or rating not between 1 and 5) as bad from fg),
    fp as (select event_id, user_id, request_ts as f_ts, request_id as f_id from (
             select *, row_number() over (partition by event_id, user_id order by request_ts, request_id) as rn
             from fs where static_reason is null and not bad and student and known_event) where rn = 1),
    fd as (select fs.*, coalesce(static_reason, case
             when fp.f_id is not null and {_before('fp.f_ts', 'fp.f_id', 'fs.request_ts', 'fs.request_id')}
               then 'ALREADY_GIVEN'
             when bad then 'BAD_RATING' when not student then 'UNKNOWN_STUDENT'
             when not known_event then 'UNKNOWN_EVENT' end) as reason
           from fs left join fp on fs.event_id = fp.event_id and fs.user_id = fp.user_id)"""

_STUDENTS = f"""
    st as (select r.*, exists (select 1 from d_students s where s.srn = r.srn) as taken,
                  (semester is null or semester not between 1 and 8) as sem_bad from d_student_requests r),
    sp as (select srn, request_ts as f_ts, request_id as f_id from (
             select *, row_number() over (partition by srn order by request_ts, request_id) as rn
             from st where not sem_bad and not taken and srn is not null) where rn = 1),
    sd as (select st.request_id, st.srn, case when sem_bad then 'INVALID_SEMESTER'
             when taken or (sp.f_id is not null and {_before('sp.f_ts', 'sp.f_id', 'st.request_ts', 'st.request_id')})
               then 'DUPLICATE_SRN' end as reason
           from st left join sp on st.srn = sp.srn)"""

_TICKETS = f"""
    tu as (select r.*, t.event_id as t_event from d_ticket_requests r left join d_tickets t on r.ticket_id = t.id),
    upd as (select * from tu where kind = 2 and t_event = event_id),
    lp as {_last("(select * from upd where new_price is not null and new_price >= 0)", "ticket_id", "new_price")},
    lq as {_last("(select * from upd where new_quantity is not null and new_quantity >= 0)", "ticket_id", "new_quantity")}"""

# One request after the other: ``st`` holds the events changed so far with
# their present venue, span and date and time texts; ``near`` the stored events
# at every venue that a request's event may have.
_UPDATES = f"""recursive
    ur as (select q.*, e.id is not null as found, e.date as o_date, e.start_ts as o_start, e.end_ts as o_end,
                  e.location_id as o_loc, e.max_participants as o_max, v.capacity as cap
           from d_event_update_requests q left join d_events e on q.event_id = e.id
           left join (select id, capacity from d_venues where is_available = 1) v on q.new_location_id = v.id),
    ud1 as (select ur.*, case when not {UPCOMING} then 'EMPTY_LIST' when not found then 'EVENT_NOT_FOUND'
             when kind is null or kind not in (1, 2, 3) then 'INVALID_CHOICE'
             when kind = 3 and not exists (select 1 from d_venues where is_available = 1) then 'EMPTY_LIST'
             when kind = 3 and cap is null then 'INVALID_VENUE' when kind = 3 and o_max > cap then 'OVER_CAPACITY'
             end as reason1 from ur),
    mv as (select *, row_number() over (order by request_ts, request_id) as seq
           from ud1 where reason1 is null and kind in (2, 3)),
    spots as (select event_id, o_loc as loc from mv union select event_id, new_location_id from mv where kind = 3),
    nears as (select spots.event_id, list({{'id': x.id, 'loc': x.location_id, 's': x.start_ts, 'e': x.end_ts}}) as near
              from spots join d_events x on x.location_id = spots.loc group by spots.event_id),
    mq as materialized (select seq, request_id, event_id, kind, new_location_id, new_date_text, new_start_text, new_end_text,
                  o_date, o_start, o_end, o_loc, coalesce(near, []) as near from mv left join nears using (event_id)),
    mwalk(seq, st, request_id, reason) as (
      select 0::bigint, []::struct(ev bigint, loc bigint, s timestamp, e timestamp, d varchar, a varchar, b varchar,
                                   timed boolean)[], null::bigint, null::varchar
      union all
      select seq, case when reason is null then list_append(list_filter(st, lambda x: x.ev <> event_id),
                       {{'ev': event_id, 'loc': tl, 's': ts, 'e': te,
                         'd': case when kind = 2 then coalesce(nullif(new_date_text, ''), cd) else cd end,
                         'a': case when kind = 2 then coalesce(nullif(new_start_text, ''), ca) else ca end,
                         'b': case when kind = 2 then coalesce(nullif(new_end_text, ''), cb) else cb end,
                         'timed': kind = 2 or coalesce(cur.timed, false)}}) else st end, request_id, reason
      from (
        select *, case when kind = 2 and (ts is null or te is null) then 'UNPARSEABLE'
                    when kind = 2 and te <= ts then 'BAD_TIME'
                    when ts < te and len(list_filter(near, lambda x: x.loc = tl and x.s < te and x.e > ts
                           and (kind = 3 or x.id <> event_id) and not list_contains(evs, x.id)))
                         + len(list_filter(st, lambda x: x.loc = tl and x.s < te and x.e > ts
                           and (kind = 3 or x.ev <> event_id))) > 0 then 'CONFLICT' end as reason
        from (
          select *, case when kind = 2 then cl else new_location_id end as tl,
                 case when kind = 2 then {parsed("(coalesce(nullif(new_date_text, ''), cd) || ' ' || coalesce(nullif(new_start_text, ''), ca))")}
                      else cs end as ts,
                 case when kind = 2 then {parsed("(coalesce(nullif(new_date_text, ''), cd) || ' ' || coalesce(nullif(new_end_text, ''), cb))")}
                      else ce end as te
          from (
            select *, case when cur is null then o_loc else cur.loc end as cl,
                   case when cur is null then o_start else cur.s end as cs, case when cur is null then o_end else cur.e end as ce,
                   coalesce(cur.d, cast(o_date as varchar)) as cd, coalesce(cur.a, strftime(o_start, '%H:%M:%S')) as ca,
                   coalesce(cur.b, strftime(o_end, '%H:%M:%S')) as cb
            from (select w.st, q.*, list_filter(w.st, lambda x: x.ev = q.event_id)[1] as cur,
                         list_transform(w.st, lambda x: x.ev) as evs
                  from mwalk w join mq q on q.seq = w.seq + 1))))),
    ud as (select ud1.*, coalesce(reason1, m.reason) as reason,
                  row_number() over (order by ud1.request_ts, ud1.request_id) as pos
           from ud1 left join mwalk m on m.request_id = ud1.request_id)"""

_BCHECK = f"""
    br as (select q.*, {parsed('start_text')} as s, {parsed('end_text')} as e from d_booking_requests q),
    bc as (select br.*, res.quantity as total,
             case when s < e then cast(coalesce((select sum(b.quantity_booked) from d_bookings b
                    where b.resource_id = br.resource_id and b.booking_start < br.e and b.booking_end > br.s), 0)
                    as bigint) end as booked,
             case when s < e then (select count(*) from d_maintenance m where m.resource_id = br.resource_id
                    and m.maintenance_start < br.e and m.maintenance_end > br.s) end as maintenance_hits
           from br left join d_resources res on res.id = br.resource_id)"""

_BODIES.update({
    "order_payment_status": """
        select r.request_id, t.price * r.how_many as total_price,
               case when t.price * r.how_many <= 0 then 'Completed' when r.paid = 1 then 'Completed' else 'Pending' end
                 as payment_status
        from d_order_requests r join d_tickets t on r.ticket_id = t.id where t.event_id = r.event_id""",
    "order_total_text": """
        select r.request_id, printf('$%.2f', t.price * r.how_many) as total
        from d_order_requests r join d_tickets t on r.ticket_id = t.id where t.event_id = r.event_id and r.how_many is not null""",
    "cancel_decisions": f"with {_CANCEL}\nselect request_id, user_id, event_id, reason, reason is null as accepted from cd",
    "refunds_by_ticket": f"""with {_CANCEL}
        select lt.ticket_id, x.event_id, x.refund
        from (select event_id, count(*) as refund from done group by event_id) x
        join (select event_id, min(id) as ticket_id from d_tickets group by event_id) lt on lt.event_id = x.event_id""",
    "orders_of_cancelled": f"""with {_CANCEL}
        select o.order_id, o.ticket_id, o.user_id, o.order_time, o.payment_status
        from d_orders o join d_tickets t on o.ticket_id = t.id
        where exists (select 1 from done d where d.event_id = t.event_id and d.user_id = o.user_id)""",
    "attendance_decisions": f"with {_ATTEND}\nselect request_id, event_id, user_id, reason, reason is null as accepted from ad",
    "attendance_after": f"""with {_ATTEND}
        select p.event_id, p.user_id, p.registration_time,
               cast(case when m.event_id is not null then 1 else p.attendance_status end as varchar) as attendance_status
        from d_participants p
        left join (select distinct event_id, user_id from ad where reason is null) m
          on p.event_id = m.event_id and p.user_id = m.user_id""",
    "venue_flag_decisions": f"""with {_VFLAG}
        select request_id, venue_id, new_status, reason, reason is null as accepted from vd""",
    "venues_after": f"""with {_VFLAG}
        select v.id, v.name, v.building, v.capacity, coalesce(l.new_status, v.is_available) as is_available
        from d_venues v left join {_last("(select * from vd where reason is null)", "venue_id", "new_status")} l
          on v.id = l.venue_id""",
    "resource_flag": f"""with {_RSTATUS}
        select request_id, resource_id, new_status, is_available, reason, reason is null as accepted from rd""",
    "resources_after": f"""with {_RSTATUS}
        select s.id, s.name, s.type, s.quantity, s.description,
               coalesce(l.is_available, s.is_available) as is_available,
               coalesce(l.new_status, s.maintenance_status) as maintenance_status
        from d_resources s
        left join {_last("(select * from rd where reason is null)", "resource_id", "new_status, is_available")} l
          on s.id = l.resource_id""",
    "resources_delta": """
        select request_id, name, type, quantity, description, 1 as is_available, 'Available' as maintenance_status
        from d_resource_requests where quantity is not null and quantity >= 0""",
    "maintenance_decisions": f"""with {_MAINT}
        select request_id, resource_id, coalesce(conflicts, 0) as conflicts, reason, reason is null as accepted from md""",
    "resources_after_maintenance": f"""with {_MAINT}
        select s.id, s.name, s.type, s.quantity, s.description,
               case when c.resource_id is not null then 0 else s.is_available end as is_available,
               case when c.resource_id is not null then 'Under Maintenance' else s.maintenance_status end
                 as maintenance_status
        from d_resources s left join (select distinct resource_id from md where reason is null) c
          on s.id = c.resource_id""",
    "feedback_eligibility": f"""with {_FEEDBACK}
        select request_id, event_id, user_id, reason, reason is null as accepted from fd""",
    "feedback_delta": f"""with {_FEEDBACK}
        select request_id, event_id, user_id, rating, comments, request_ts as submitted_at from fd where reason is null""",
    "unique_students": f"with {_STUDENTS}\nselect request_id, srn, reason, reason is null as accepted from sd",
    "tickets_after_update": f"""with {_TICKETS}
        select t.id, t.event_id, t.ticket_type, coalesce(lp.new_price, t.price) as price,
               coalesce(lq.new_quantity, t.quantity) as quantity
        from d_tickets t left join lp on lp.ticket_id = t.id left join lq on lq.ticket_id = t.id""",
    "tickets_added": """
        select request_id, event_id, ticket_type, price, quantity from d_ticket_requests
        where kind = 1 and event_id in (select id from d_events)""",
    "event_update_decisions": f"""with {_UPDATES}
        select request_id, event_id, kind, reason, reason is null as accepted from ud""",
    "booking_check": f"""with {_BCHECK}
        select request_id, resource_id,
               case when not {UPCOMING} then 'EMPTY_LIST' when not exists (select 1 from d_resources) then 'EMPTY_LIST'
                    when total is null then 'INVALID_RESOURCE' when quantity is null or quantity > total then 'OVER_TOTAL'
                    when quantity <= 0 then 'NON_POSITIVE' when s is null or e is null then 'UNPARSEABLE'
                    when e <= s then 'BAD_TIME' when maintenance_hits > 0 then 'MAINTENANCE'
                    when quantity > total - booked then 'INSUFFICIENT' end as reason
        from bc""",
})

# ------------------------------------------------------------------------
# Order-dependent flows: a recursive walk through each key's requests in
# batch order, carrying the state (stock, registrations, accepted slots) as
# lists. Slow in general, fine at the check's scale; written from the rules,
# independently of the Spark rounds.

_ORDER_WALK = f"""with recursive
    oq as (select r.*, row_number() over (partition by r.event_id order by r.request_ts, r.request_id) as seq,
                  exists (select 1 from d_students s where s.id = r.user_id) as known,
                  {UPCOMING} as up_gate, exists (select 1 from d_students) as st_gate,
                  case when t.price * r.how_many <= 0 then 'Completed' when r.paid = 1 then 'Completed'
                       else 'Pending' end as pay
           from d_order_requests r left join d_tickets_unset t on t.id = r.ticket_id),
    oinit as (select e.event_id,
                     coalesce((select list({{'tid': t.id, 'q': t.quantity}}) from d_tickets_unset t
                               where t.event_id = e.event_id), []) as stock,
                     coalesce((select list(p.user_id) from d_participants p where p.event_id = e.event_id), []) as regs
              from (select distinct event_id from oq) e),
    owalk(event_id, seq, stock, regs, request_id, reason) as (
      select event_id, 0::bigint, stock, regs, null::bigint, null::varchar from oinit
      union all
      select w.event_id, q.seq,
             case when ({{R}}) is null then list_transform(w.stock, lambda s: case when s.tid = q.ticket_id
                  then {{{{'tid': s.tid, 'q': s.q - q.how_many}}}} else s end) else w.stock end,
             case when ({{R}}) is null and q.pay = 'Completed' then list_append(w.regs, q.user_id) else w.regs end,
             q.request_id, ({{R}})
      from owalk w join oq q on q.event_id = w.event_id and q.seq = w.seq + 1),
    od as (select q.request_id, q.event_id, q.ticket_id, q.user_id, q.how_many, q.pay as payment_status,
                  q.request_ts, w.reason
           from owalk w join oq q on q.request_id = w.request_id)"""

_ORDER_REASON = """case when not q.up_gate then 'EMPTY_LIST'
       when len(list_filter(w.stock, lambda s: s.q > 0)) = 0 then 'NO_TICKETS'
       when len(list_filter(w.stock, lambda s: s.q > 0 and s.tid = q.ticket_id)) = 0 then 'INVALID_TICKET'
       when q.how_many is null or q.how_many <= 0 then 'NON_POSITIVE'
       when q.how_many > list_filter(w.stock, lambda s: s.tid = q.ticket_id)[1].q then 'OVER_QUANTITY'
       when not q.st_gate then 'EMPTY_LIST'
       when not q.known then 'UNKNOWN_STUDENT'
       when q.pay = 'Completed' and list_contains(w.regs, q.user_id) then 'ALREADY_REGISTERED' end"""

_ORDER_WALK = _ORDER_WALK.replace("{R}", _ORDER_REASON).replace("{{", "{").replace("}}", "}")

_EVENT_WALK = f"""with recursive
    er as (select q.*, {parsed("(date_text || ' ' || start_text)")} as s,
                  {parsed("(date_text || ' ' || end_text)")} as e from d_event_requests q),
    es as (select er.*, v.capacity, exists (select 1 from d_hosts h where h.id = er.organizer_id) as host_ok,
                  case when er.s < er.e then (select count(*) from d_events x where x.location_id = er.location_id
                       and x.start_ts < er.e and x.end_ts > er.s) end as stored_conf
           from er left join (select id, capacity from d_venues where is_available = 1) v on v.id = er.location_id),
    esr as (select es.*, case when s is null or e is null then 'UNPARSEABLE' when e <= s then 'BAD_TIME'
                  when not exists (select 1 from d_hosts) then 'EMPTY_LIST'
                  when not exists (select 1 from d_venues where is_available = 1) then 'EMPTY_LIST'
                  when capacity is null then 'INVALID_VENUE'
                  when max_participants is null or max_participants > capacity then 'OVER_CAPACITY'
                  when stored_conf > 0 then 'CONFLICT' end as static_reason from es),
    ec as (select esr.*, row_number() over (partition by location_id order by request_ts, request_id) as seq
           from esr where static_reason is null),
    ewalk(location_id, seq, acc, request_id, reason) as (
      select distinct location_id, 0::bigint, []::struct(s timestamp, e timestamp)[], null::bigint, null::varchar
      from ec
      union all
      select w.location_id, c.seq,
             case when (R) is null then list_append(w.acc, {{'s': c.s, 'e': c.e}}) else w.acc end, c.request_id, (R)
      from ewalk w join ec c on c.location_id = w.location_id and c.seq = w.seq + 1),
    ed as (select request_id, location_id, static_reason as reason from esr where static_reason is not null
           union all
           select request_id, location_id, reason from ewalk where request_id is not null)""".replace(
    "(R)", "(case when len(list_filter(w.acc, lambda a: a.s < c.e and a.e > c.s)) > 0 then 'CONFLICT' "
           "when not c.host_ok then 'UNKNOWN_HOST' end)")

_BOOKING_WALK = f"""with recursive {_BCHECK},
    bs as (select bc.*, exists (select 1 from d_events x where x.id = bc.event_id) as event_ok,
                  case when not {UPCOMING} then 'EMPTY_LIST' when not exists (select 1 from d_resources) then 'EMPTY_LIST'
                       when total is null then 'INVALID_RESOURCE'
                       when quantity is null or quantity > total then 'OVER_TOTAL'
                       when quantity <= 0 then 'NON_POSITIVE' when s is null or e is null then 'UNPARSEABLE'
                       when e <= s then 'BAD_TIME' when maintenance_hits > 0 then 'MAINTENANCE'
                       when quantity > total - booked then 'INSUFFICIENT' end as static_reason
           from bc),
    bq as (select bs.*, row_number() over (partition by resource_id order by request_ts, request_id) as seq
           from bs where static_reason is null),
    bwalk(resource_id, seq, acc, request_id, reason) as (
      select distinct resource_id, 0::bigint, []::struct(s timestamp, e timestamp, q int)[], null::bigint,
             null::varchar from bq
      union all
      select w.resource_id, c.seq,
             case when (R) is null then list_append(w.acc, {{'s': c.s, 'e': c.e, 'q': c.quantity}}) else w.acc end,
             c.request_id, (R)
      from bwalk w join bq c on c.resource_id = w.resource_id and c.seq = w.seq + 1),
    bd as (select request_id, resource_id, quantity, static_reason as reason from bs where static_reason is not null
           union all
           select w.request_id, w.resource_id, c.quantity, w.reason from bwalk w join bq c on c.request_id = w.request_id)
""".replace("{{", "{").replace("}}", "}").replace(
    "(R)", "(case when c.quantity > c.total - c.booked - coalesce(list_sum(list_transform(list_filter(w.acc, "
           "lambda a: a.s < c.e and a.e > c.s), lambda a: a.q)), 0) then 'INSUFFICIENT' "
           "when not c.event_ok then 'UNKNOWN_EVENT' end)")

_HOST_WALK = """with recursive
    hr as (select request_id, request_ts, email, nullif(phone, '') as phone,
                  row_number() over (order by request_ts, request_id) as seq from d_host_requests),
    hwalk(seq, emails, phones, request_id, ok) as (
      select 0::bigint, coalesce((select list(email) from d_hosts where email is not null), []),
             coalesce((select list(phone) from d_hosts where phone is not null), []), null::bigint, null::boolean
      union all
      select h.seq,
             case when (OK) and h.email is not null then list_append(w.emails, h.email) else w.emails end,
             case when (OK) and h.phone is not null then list_append(w.phones, h.phone) else w.phones end,
             h.request_id, (OK)
      from hwalk w join hr h on h.seq = w.seq + 1)""".replace(
    "(OK)", "((h.email is null or not list_contains(w.emails, h.email)) and "
            "(h.phone is null or not list_contains(w.phones, h.phone)))")

_BODIES.update({
    "order_decisions": _ORDER_WALK + """
        select request_id, event_id, ticket_id, user_id, how_many, payment_status, reason, reason is null as accepted
        from od""",
    "ticket_stock_after": _ORDER_WALK + """
        select t.id, t.event_id, t.ticket_type, t.price,
               cast(cast(t.quantity - coalesce(u.used, 0) as int) as varchar) as quantity
        from d_tickets_unset t left join (select ticket_id, sum(how_many) as used from od where reason is null
                                    group by ticket_id) u on u.ticket_id = t.id""",
    "orders_delta": _ORDER_WALK + """
        select request_id, ticket_id, user_id, request_ts as order_time, payment_status,
               cast(unnest(generate_series(1, how_many)) as int) as seq
        from od where reason is null""",
    "event_admission": _EVENT_WALK + """
        select request_id, location_id, reason, reason is null as accepted from ed""",
    "events_delta": _EVENT_WALK + """
        select r.request_id, r.name, r.description, cast(cast(r.s as date) as varchar) as date, r.s as start_ts,
               r.e as end_ts, r.location_id, r.organizer_id, 'Scheduled' as status, r.max_participants
        from er r join ed d on d.request_id = r.request_id where d.reason is null""",
    "booking_decisions": _BOOKING_WALK + """
        select request_id, resource_id, quantity, reason, reason is null as accepted from bd""",
    "host_decisions": _HOST_WALK + """
        select w.request_id, h.email, h.phone, w.ok as accepted,
               case when w.ok then null else 'DUPLICATE_EMAIL_OR_PHONE' end as reason
        from hwalk w join hr h on h.request_id = w.request_id""",
})

_BODIES.update({
    "event_request_conflict_names": f"""
        select request_id, event_id, event_name from (
          select r.request_id, e.id as event_id, e.name as event_name,
                 row_number() over (partition by r.request_id order by e.id) as rn
          from {_event_span('d_event_requests', 'request_id, location_id')} r
          join d_events e on e.location_id = r.location_id and e.start_ts < r.end_ts and e.end_ts > r.start_ts
          where r.start_ts < r.end_ts) where rn = 1""",
    "maintenance_conflict_names": f"""
        select request_id, booking_id, event_name from (
          select r.request_id, b.id as booking_id, e.name as event_name,
                 row_number() over (partition by r.request_id order by b.id) as rn
          from {_span('d_maintenance_requests', 'request_id, resource_id')} r
          join d_bookings b on b.resource_id = r.resource_id and b.booking_start < r.end_ts and b.booking_end > r.start_ts
          join d_events e on e.id = b.event_id
          where r.start_ts < r.end_ts) where rn = 1""",
    "events_after_update": f"""with {_UPDATES},
        k1 as (select event_id, arg_max(nullif(new_name, ''), pos) filter (where nullif(new_name, '') is not null) as nn,
                      arg_max(nullif(new_description, ''), pos) filter (where nullif(new_description, '') is not null) as nd
               from ud where kind = 1 and reason is null group by event_id),
        k2 as (select unnest(st, max_depth := 2) from (select st from mwalk order by seq desc limit 1))
        select e.id, coalesce(k1.nn, e.name) as name, coalesce(k1.nd, e.description) as description,
               cast(case when k2.timed then cast(k2.s as date) else e.date end as varchar) as date,
               case when k2.timed then k2.s else e.start_ts end as start_ts,
               case when k2.timed then k2.e else e.end_ts end as end_ts,
               cast(coalesce(k2.loc, e.location_id) as varchar) as location_id, e.organizer_id, e.status,
               e.max_participants
        from d_events e left join k1 on k1.event_id = e.id left join k2 on k2.ev = e.id""",
    "students_delta": f"""with {_STUDENTS}
        select r.request_id, r.srn, r.name, r.semester, r.section
        from d_student_requests r join sd on sd.request_id = r.request_id where sd.reason is null""",
    "hosts_delta": _HOST_WALK + """
        select w.request_id, r.name, h.email, h.phone, r.role, nullif(r.department, '') as department
        from hwalk w join hr h on h.request_id = w.request_id join d_host_requests r on r.request_id = w.request_id
        where w.ok""",
    "bookings_delta": _BOOKING_WALK + """
        select c.request_id, c.event_id, c.resource_id, c.quantity as quantity_booked, c.s as booking_start,
               c.e as booking_end
        from bd join bs c on c.request_id = bd.request_id where bd.reason is null""",
    "maintenance_delta": f"""with {_MAINT}
        select request_id, resource_id, s as maintenance_start, e as maintenance_end, description
        from md where reason is null""",
    "participants_delta": _ORDER_WALK + """
        select event_id, user_id, request_ts as registration_time, cast(null as varchar) as attendance_status from od
        where reason is null and payment_status = 'Completed'""",
})
