"""Plain SQL for every catalogue query, run by DuckDB over the same tables.

Each statement is written from the meaning of the query, not from its Spark plan:
polls are blended one by one, moving averages are one window, transfers are two
explicit steps.
"""

from __future__ import annotations

# Shared views, each a WITH clause over the tables and the views before it.
VIEWS = {
    "result": """
        select case when o_orderdate < timestamp '1998-01-01' then 'prev' else 'cur' end as election_id,
               l_suppkey as seat, concat('p', substr(o_orderpriority, 1, 1)) as party,
               cast(substr(o_orderpriority, 1, 1) as int) as party_ord, cast(sum(l_quantity) as bigint) as votes
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4""",
    "seat": """
        select s_suppkey as seat, s_name as name, n_name as region, r_name as region_group, e.electorate,
               case when s_suppkey % 7 = 0 then 'May 6th 2021' end as by_election
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        left join (select l_suppkey as k, cast(sum(l_quantity) as bigint) as electorate from lineitem group by 1) e
          on e.k = s_suppkey""",
    "pair": """
        select 'latest' as view_id, seat, party, party_ord,
               cast(sum(case when election_id = 'cur' then votes end) as bigint) as votes,
               cast(sum(case when election_id = 'prev' then votes end) as bigint) as prev_votes
        from result group by 2, 3, 4
        union all
        select 'again', seat, party, party_ord, votes, votes from result where election_id = 'cur'""",
    "ranked": """
        select *, row_number() over (partition by view_id, seat order by votes desc nulls last, party_ord) as rn,
               row_number() over (partition by view_id, seat order by prev_votes desc nulls last, party_ord) as prn,
               sum(votes) over (partition by view_id, seat) as turnout,
               sum(prev_votes) over (partition by view_id, seat) as prev_turnout
        from pair""",
    "seat_rows": """
        select view_id, r.seat, any_value(name) as name, any_value(region) as region,
               any_value(region_group) as region_group, any_value(electorate) as electorate,
               any_value(by_election) as by_election,
               max(case when rn = 1 then party end) as winner,
               max(case when prn = 1 and prev_votes is not null then party end) as prev_winner,
               cast(max(turnout) as bigint) as turnout, cast(max(prev_turnout) as bigint) as prev_turnout,
               max(case when rn = 1 then votes end) - coalesce(max(case when rn = 2 then votes end), 0) as majority
        from ranked r join seat on seat.seat = r.seat where turnout is not null group by 1, 2""",
    "seat_full": """
        select view_id, seat, name, region, region_group, electorate, by_election, winner, prev_winner, turnout,
               prev_turnout, majority, 100.0::double * majority / turnout as majority_pct,
               100.0::double * turnout / electorate as turnout_pct
        from seat_rows""",
    "area_map": """
        select n_name as area, n_name as region from nation
        union select r_name, n_name from nation join region on n_regionkey = r_regionkey
        union select 'ALL', n_name from nation""",
    "groups": "select r_name as region_group, n_name as region from nation join region on n_regionkey = r_regionkey",
    "won": """
        select election_id, seat, party as winner, votes as winner_votes,
               lead(party) over w as runner_up, lead(votes) over w as runner_up_votes,
               cast(sum(votes) over (partition by election_id, seat) as bigint) as turnout, row_number() over w as rn
        from result window w as (partition by election_id, seat order by votes desc, party_ord)""",
    "winners": """
        select election_id, seat, winner, winner_votes, runner_up, runner_up_votes, turnout,
               winner_votes - coalesce(runner_up_votes, 0) as majority,
               100.0::double * (winner_votes - coalesce(runner_up_votes, 0)) / turnout as majority_pct
        from won where rn = 1""",
    "poll_raw": """
        select day(ts) * 8 + user_id % 8 as code, concat('c', cast(user_id % 8 as varchar)) as company,
               cast(ts as date) as fieldwork_date, r_name as area,
               case event_type when 'click' then 'p1' when 'error' then 'p2' when 'purchase' then 'p3'
                               when 'signup' then 'p4' else 'p5' end as party,
               cast(floor(value) as bigint) as v
        from events join region on r_regionkey = user_id % 5""",
    "poll": """
        select a.code, a.company, a.fieldwork_date, a.area, p.party,
               cast(coalesce(n.n, 0) as bigint) as n, a.total
        from (select code, company, fieldwork_date, area, cast(sum(v) as bigint) as total
              from poll_raw group by 1, 2, 3, 4) a
        join (select unnest(['p1', 'p2', 'p3', 'p4', 'p5']) as party) p on true
        left join (select code, company, fieldwork_date, area, party, sum(v) as n
                   from poll_raw group by 1, 2, 3, 4, 5) n
          on n.code = a.code and n.company = a.company and n.fieldwork_date = a.fieldwork_date
             and n.area = a.area and n.party = p.party""",
    "crosswalk": """
        select distinct p.company, p.area, g.region from poll_raw p join groups g on g.region_group = p.area""",
    "pollster": """
        select concat('c', cast(i as varchar)) as company, 1.0::double + i / 4.0::double as base_weight,
               case when i = 7 then 50.0::double end as fixed_weight
        from (select unnest(range(0, 8)) as i)""",
    "fractions": """
        select *, case when total = 0 then null else n::double / total end as fraction from poll""",
    "weighted": """
        select f.*, coalesce(fixed_weight, base_weight * pow(0.7::double, date '2024-02-01' - fieldwork_date)) as weight
        from fractions f join pollster using (company) where fieldwork_date <= date '2024-02-01'""",
    "old_votes": """
        select region, party, cast(sum(votes) as bigint) as votes from result join seat using (seat)
        where election_id = 'prev' group by 1, 2""",
    "old": """
        select r.region, p.party, coalesce(v.votes, 0) as votes, t.turnout,
               coalesce(v.votes, 0)::double / t.turnout as share
        from (select distinct region from old_votes) r
        join (select unnest(['p1', 'p2', 'p3', 'p4', 'p5']) as party) p on true
        join (select region, cast(sum(votes) as bigint) as turnout from old_votes group by 1) t on t.region = r.region
        left join old_votes v on v.region = r.region and v.party = p.party""",
    "area_old": """
        select company, area, party, sum(votes)::double / sum(turnout) as area_share
        from old join crosswalk using (region) group by 1, 2, 3""",
    "estimates": """
        select o.region, o.party, o.share as old_share, e.estimate, e.estimate is not null as had_polls
        from old o left join (
            select x.region, w.party, sum(w.weight * (o2.share + w.fraction - a.area_share)) as estimate
            from weighted w join crosswalk x using (company, area)
            join old o2 on o2.region = x.region and o2.party = w.party
            join area_old a on a.company = w.company and a.area = w.area and a.party = w.party
            where w.fraction is not null group by 1, 2) e on e.region = o.region and e.party = o.party""",
    "corrected": """
        select code, company, fieldwork_date, area, party, n, total from poll where company not in ('c0', 'c5')
        union all
        select a.code, a.company, a.fieldwork_date, a.area, a.party,
               a.n - case when a.area = 'AFRICA' then coalesce(s.n, 0) else 0 end,
               a.total - case when a.area = 'AFRICA' then coalesce(s.total, 0) else 0 end
        from poll a left join poll s on s.code = a.code and s.company = a.company
             and s.fieldwork_date = a.fieldwork_date and s.area = 'ASIA' and s.party = a.party
        where a.company = 'c0'
        union all
        select a.code, a.company, a.fieldwork_date, a.area, a.party,
               case when a.area = 'AFRICA' then coalesce(s.n, 0) + coalesce(e.n, 0) else a.n end,
               case when a.area = 'AFRICA' then coalesce(s.total, 0) + coalesce(e.total, 0) else a.total end
        from poll a
        left join poll s on s.code = a.code and s.company = a.company and s.fieldwork_date = a.fieldwork_date
             and s.area = 'ASIA' and s.party = a.party
        left join poll e on e.code = a.code and e.company = a.company and e.fieldwork_date = a.fieldwork_date
             and e.area = 'EUROPE' and e.party = a.party
        where a.company = 'c5' and a.area <> 'EUROPE'""",
    "nowcast_estimates": """
        select o.region, o.party, o.share as old_share, e.estimate, e.estimate is not null as had_polls
        from old o left join (
            select x.region, w.party,
                   sum(coalesce(fixed_weight, base_weight * pow(0.7::double, date '2024-02-01' - fieldwork_date))
                       * (o2.share + w.n::double / w.total - a.area_share)) as estimate
            from corrected w join pollster using (company) join crosswalk x using (company, area)
            join old o2 on o2.region = x.region and o2.party = w.party
            join area_old a on a.company = w.company and a.area = w.area and a.party = w.party
            where w.total <> 0 and fieldwork_date <= date '2024-02-01' group by 1, 2) e on e.region = o.region and e.party = o.party""",
    "nowcast_change": """
        select region, party, old_share, had_polls,
               case when old_share <> 0 then
                 case when had_polls then greatest(estimate, 0) / sum(greatest(estimate, 0)) over (partition by region)
                                          - old_share else 0 end end as change
        from nowcast_estimates""",
    "before": """
        select view_id, region, party, cast(sum(prev_votes) as bigint) as votes
        from pair join seat using (seat) where prev_votes is not null group by 1, 2, 3""",
    "group_region": """
        select b.view_id, g.region_group, g.region, p.party, coalesce(v.votes, 0) as votes
        from (select distinct view_id, region from before) b join groups g on g.region = b.region
        join (select unnest(['p1', 'p2', 'p3', 'p4', 'p5']) as party) p on true
        left join before v on v.view_id = b.view_id and v.region = b.region and v.party = p.party""",
    "group_shares": """
        select r.view_id, r.region_group, r.region, r.party, r.votes,
               100.0::double * r.votes / sum(r.votes) over (partition by r.view_id, r.region_group, r.region) as region_pct,
               o.overall_pct
        from group_region r join (
            select view_id, region_group, party,
                   100.0::double * sum(votes) / sum(sum(votes)) over (partition by view_id, region_group) as overall_pct
            from group_region group by 1, 2, 3) o
          on o.view_id = r.view_id and o.region_group = r.region_group and o.party = r.party""",
    "inputs": """
        select company as scenario_id, v.view_id, area as region_group, party,
               100.0::double * n / total * (0.9::double + cast(substr(company, 2, 1) as int) / 16.0::double) as pct
        from (select company, area, party, sum(n) as n, sum(sum(n)) over (partition by company, area) as total
              from poll group by 1, 2, 3) join (select unnest(['latest', 'again']) as view_id) v on true
        where party <> 'p5'""",
    "clean_inputs": """
        select *, sum(h) over w as sum_h, max(h) over w as max_h
        from (select *, cast(floor(greatest(pct, 0) * 100.0::double + 0.5::double) as bigint) as h from inputs)
        window w as (partition by scenario_id, view_id, region_group)""",
    "accepted": """
        select scenario_id, view_id, region_group, party, h / 100.0::double as pct,
               (10000 - sum_h) / 100.0::double as other_pct
        from clean_inputs where max_h > 0 and sum_h <= 10000""",
    "moved": """
        select a.scenario_id, a.view_id, a.region_group, g.region, g.party, g.region_pct,
               greatest(g.region_pct + (case when g.party = 'p5' then a.other_pct else coalesce(i.pct, 0) end
                                        - g.overall_pct), 0) as new_pct
        from (select distinct scenario_id, view_id, region_group, other_pct from accepted) a
        join group_shares g on g.view_id = a.view_id and g.region_group = a.region_group
        left join accepted i on i.scenario_id = a.scenario_id and i.view_id = a.view_id
             and i.region_group = a.region_group and i.party = g.party""",
    "changes": """
        select scenario_id, view_id, region_group, region, party,
               new_pct / (sum(new_pct) over (partition by scenario_id, view_id, region) / 100.0::double)
               - region_pct as change
        from moved""",
    "marked": """
        select r.election_id, r.seat, r.party, r.party_ord, r.votes,
               case when (r.party = 'p5' and s.by_election is not null)
                      or (r.party = 'p4' and s.region_group in ('ASIA', 'EUROPE')) then 0 end as standing
        from result r join seat s using (seat)""",
    "rules_raw": """
        select company as scenario_id, e.election_id, party as party_to,
               cast(floor(case when company = 'c7' then 200.0::double else 100.0::double end * n / total) as int) as pct
        from (select company, party, sum(n) as n, sum(sum(n)) over (partition by company) as total
              from poll group by 1, 2) join (select unnest(['cur', 'prev']) as election_id) e on true
        where party in ('p1', 'p2', 'p3')""",
    "rules_all": """
        select scenario_id, election_id, s.ord, s.party_from, party_to, pct,
               cast(100 - sum(pct) over (partition by scenario_id, election_id, s.party_from) as int) as not_voting
        from rules_raw join (select 1 as ord, 'p5' as party_from union all select 2, 'p4') s on true""",
    "rules": "select * from rules_all where not_voting >= 0 and not_voting <> 100",
    "points": """
        select code, company, fieldwork_date, k.party,
               floor(coalesce(100.0::double * case k.party when 'p1' then v1 when 'p2' then v2 when 'p3' then v3
                                              else vr end / nullif(v_all, 0), 0) * 10.0::double + 0.5::double) / 10.0::double as pct
        from (select code, company, fieldwork_date, sum(v) as v_all,
                     sum(case when party = 'p1' then v end) as v1, sum(case when party = 'p2' then v end) as v2,
                     sum(case when party = 'p3' then v end) as v3,
                     sum(case when party not in ('p1', 'p2', 'p3') then v end) as vr
              from (select *, case when company = 'c0' then n * total / 100.0::double else n::double end as v from poll
                    where not (company = 'c1' and area = 'ASIA')) group by 1, 2, 3)
        join (select unnest(['p1', 'p2', 'p3', 'others']) as party) k on true""",
    "referendum": """
        select l.seat, leave, 100.0::double - leave as remain,
               case when leave > 100.0::double - leave then 'leave' else 'remain' end as current,
               w.winner as winner2015, s.region
        from (select l_suppkey as seat, 100.0::double * sum(case when l_linestatus = 'O' then l_quantity else 0 end)
                     / sum(l_quantity) as leave from lineitem group by 1) l
        join winners w on w.seat = l.seat and w.election_id = 'prev' join seat s on s.seat = l.seat""",
    "card": """
        select p_partkey as card_id, p_name as name, p_brand as card_class, p_type as type,
               concat('R', cast(p_partkey % 5 as varchar)) as rarity, concat('T', cast(p_partkey % 3 as varchar)) as race,
               concat('S', cast(p_partkey % 13 as varchar)) as card_set, p_size % 12 as cost,
               string_split(p_name, ' ') as mechanics,
               case when p_partkey % 13 in (0, 1, 2, 5, 8, 12) then 'standard' else 'wild' end as mode,
               case when p_size % 12 >= 7 then '7plus' else cast(p_size % 12 as varchar) end as cost_bucket
        from part""",
    "lines": """
        select doc_id, source, i - 1 as pos, l[i] as event
        from (select doc_id, source, l, unnest(range(1, len(l) + 1)) as i
              from (select doc_id, source, string_split(text, chr(10)) as l from documents))""",
    "fact_base": """
        select concat(doc_id, ':', pos) as fact_id, cast(1 + doc_id % 2000 as int) as year,
               case when doc_id % 5 = 0 then 'BC' else 'AD' end as era, event from lines""",
    "fact": "select * from (select *, {timeframe} from fact_base)",
    "link": """
        select concat('seats-', region, '-', party) as link_id, 'latest' as view_id, party as incumbent,
               null as challenger, lower(region) as region, 0.0::double as lo,
               cast(length(region) * 2 + cast(substr(party, 2, 1) as int) as double) as hi,
               party = 'p1' as gains, false as by_election
        from (select distinct region, party from result join seat using (seat))
        union all
        select concat('party-', party), 'latest', party, null, null, 0.0::double, 100.0::double, false, true
        from (select distinct party from result)
        union all
        select concat('duel-', region), 'latest', 'p1', 'p2', lower(region), 0.0::double, 30.0::double, false, false
        from (select distinct region from result join seat using (seat))""",
}

TIMEFRAME = """
    case when era = 'AD' and year < 1000 then concat('AD_', year) when era = 'AD' then cast(year as varchar)
         when year <= 500 then concat(year, '_BC')
         when year <= 1799 and year % 100 = 0 then concat(year, 's_BC_(decade)')
         when year <= 1799 then concat(year // 10 * 10, 's_BC')
         else concat((year - 1) // 100 + 1,
                     case when ((year - 1) // 100 + 1) in (11, 12, 13) then 'th'
                          when ((year - 1) // 100 + 1) % 10 = 1 then 'st' when ((year - 1) // 100 + 1) % 10 = 2 then 'nd'
                          when ((year - 1) // 100 + 1) % 10 = 3 then 'rd' else 'th' end, '_century_BC') end as title,
    case when era = 'AD' and year < 1000 then cast(year as varchar) when era = 'AD' then concat('AD_', year) end as fallback,
    case when era = 'AD' or year <= 500 then 'year' when year <= 1799 then 'decade' else 'century' end as timeframe_type,
    cast(case when era = 'AD' or year <= 500 then year when year <= 1799 then year // 10 * 10
              else (year - 1) // 100 * 100 + 1 end as int) as first_year,
    cast(case when era = 'AD' or year <= 500 then year when year <= 1799 then year // 10 * 10 + 9
              else ((year - 1) // 100 + 1) * 100 end as int) as last_year"""


def _round(expr: str, places: int) -> str:
    scale = f"{10 ** places}.0::double"
    return f"floor(({expr}) * {scale} + 0.5::double) / {scale}"


def _scaled(expr: str, factor: str) -> str:
    return f"cast(floor(({expr}) * {factor}::double + 0.5::double) as bigint)"


def _sub(expr: str, pattern: str, to: str, flags: str = "g") -> str:
    pattern, to = pattern.replace("'", "''"), to.replace("'", "''")
    return f"regexp_replace({expr}, '{pattern}', '{to}', '{flags}')"


_STRIP = r"^\s+|\s+$"
_LETTER = r"\p{L}\p{N}_"


def _first_sentences(expr: str, n: int = 2) -> str:
    pairs = [("St", "St", "St."), ("Mt", "Mt", "Mt."), ("Dr", "Dr", "Dr."), ("Mr", "Mr", "Mr."),
             ("Mrs", "Mrs", "Mrs."), ("[Cc]", "C", "c."), ("[Cc]a", "Ca", "ca.")]
    for pattern, key, _ in pairs:
        for _again in range(2):  # the character before a match is consumed, so repeat for neighbours
            expr = _sub(expr, rf"(^|[^{_LETTER}]){pattern}\.\s", rf"\1{key}#@# ")
    expr = _sub(expr, r"([.!?])\s+([A-Z])", r"\1#%#\2")
    expr = f"array_to_string(string_split({expr}, '#%#')[1:{n}], ' ')"
    for _, key, back in pairs:
        expr = f"replace({expr}, '{key}#@#', '{back}')"
    return expr


def _plain_text(expr: str) -> str:
    expr = _sub(expr, r"<sup\b.*?</sup>", "", "gis")
    expr = _sub(expr, r"<[^>]*>", "")
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
        expr = f"replace({expr}, '{entity}', '{char}')"
    return _sub(expr, _STRIP, "")


def _yearly(condition: str) -> str:
    """Seats per year and party, of the orders that meet a condition."""
    return f"""
        select y.date, k.party, cast(count(case when y.winner = k.party
                                             or (k.party = 'others' and y.winner not in ('p1', 'p2', 'p3')) then 1 end)
                                     as bigint) as seats
        from (select cast(date_trunc('year', o_orderdate) as date) as date, l_suppkey as seat,
                     concat('p', substr(o_orderpriority, 1, 1)) as winner,
                     row_number() over (partition by date_trunc('year', o_orderdate), l_suppkey
                                        order by cast(sum(l_quantity) as bigint) desc, substr(o_orderpriority, 1, 1)) as rn
              from lineitem join orders on l_orderkey = o_orderkey where {condition}
              group by date_trunc('year', o_orderdate), l_suppkey, substr(o_orderpriority, 1, 1)) y
        join (select unnest(['p1', 'p2', 'p3', 'others']) as party) k on true
        where y.rn = 1 group by 1, 2"""


VIEWS["history"] = _yearly("true")
VIEWS["recount"] = _yearly("o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01'")


def _cleaned_views() -> dict[str, str]:
    """The cleaning rules step by step, each step a view over the one before."""
    steps = [
        _sub("event", _STRIP, ""),
        _sub("t", r"^(?:[Cc]\.\s+|[Cc]a\.\s+|[Cc]irca\s+)[—–-]?\s*", "", ""),
        _sub("t", r"\[[0-9]+\]", ""),
        _sub("t", r"\n+", " "),
        _first_sentences("t"),
        _sub("t", r"\b[0-9]+(?:st|nd|rd|th)\s+century\b", "", "gi"),
        rf"""array_to_string(list_transform(regexp_extract_all(t, '[{_LETTER}]+|[^{_LETTER}]+'),
             lambda x: case when lower(x) in ('ad', 'bc', 'bce', 'ce') then ''
                            when regexp_full_match(x, '[0-9]{{1,4}}') and abs(try_cast(x as int) - year) <= 100
                            then 'YYYY' else x end), '')""",
        _sub("t", r"\bYYYY-year-old\b", "young"),
        _sub("t", r"\bYYYY years?\b", "some years"),
        _sub("t", r"\bYYYY months?\b", "several months"),
        _sub("t", r"\bYYYY\b", ""),
        _sub("t", r"\(\s*[,.]?\s*\)", ""),
        _sub("t", rf"\(\s*[{_LETTER}]*\s*\)", ""),
        _sub("t", r"\s{2,}", " "),
        _sub("t", r"\s+([,.])", r"\1"),
        _sub("t", r"\s+([,])\s+", r"\1 "),
    ]
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    views, source = {}, "fact"
    for i, step in enumerate(steps):
        views[f"step{i}"] = f"select * replace ({step} as t) from {source}" if i else f"select *, {step} as t from {source}"
        source = f"step{i}"
    body = _sub("t", _STRIP, "")
    views["cleaned"] = rf"""
        select fact_id, year, era, timeframe_type, event,
               case when (regexp_matches(t, '^(?:{months})\s+[A-Z]') and length(t) < 50) or length(b) < 30
                      or len(string_split_regex(b, '\s+')) < 5 then ''
                    else concat(upper(b[1:1]), b[2:], case when regexp_matches(b, '[.!?]$') then '' else '.' end)
               end as cleaned
        from (select *, {body} as b from {source})"""
    views["judged"] = "select *, length(cleaned) > 30 and not starts_with(cleaned, 'C. ') as kept from cleaned"
    return views


VIEWS = {**{k: v.format(timeframe=TIMEFRAME) if "{timeframe}" in v else v for k, v in VIEWS.items()}, **_cleaned_views()}


def _sql(body: str) -> str:
    """Puts the views the statement needs, directly or through others, before it."""
    import re

    def uses(text: str) -> set[str]:
        words = set(re.findall(r"\b(?:from|join)\s+([a-z_0-9]+)", text))
        return words & set(VIEWS)

    needed, todo = set(), list(uses(body))
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo.extend(uses(VIEWS[name]) - needed)
    clauses = ", ".join(f"{name} as ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"with {clauses} {body}" if clauses else body


_DIRECTION = """
    select view_id, seat, bucket, sum(votes) as v, sum(prev_votes) as pv, max(turnout) as t, max(prev_turnout) as pt
    from (select *, case party when 'p1' then 'con' when 'p2' then 'lab' when 'p3' then 'lib' else 'nat' end as bucket
          from ranked) where turnout is not null group by 1, 2, 3"""

_COMPARED = """
    select view_id, seat, party, votes, prev_votes, turnout, prev_turnout,
           100.0::double * votes / turnout as share_pct,
           coalesce(100.0::double * prev_votes / prev_turnout, 0.0::double) as prev_share_pct,
           first_value(party) over (partition by view_id, seat order by votes desc nulls last, party_ord) as winner,
           party_ord
    from ranked where votes is not null"""

_PROJECTED = """
    select election_id, seat, region, turnout, party, party_ord, in_seat, raw,
           case when in_seat and share = 0 then 0
                when in_seat then greatest(raw, 0.1::double * share) else greatest(change, 0) end as drawn
    from (select s.election_id, s.seat, s.region, s.turnout, k.party, cast(substr(k.party, 2, 1) as int) as party_ord,
                 r.votes is not null as in_seat, coalesce(r.votes, 0)::double / s.turnout as share, c.change,
                 coalesce(c.change + r.votes::double / s.turnout, 0) as raw
          from (select election_id, seat, any_value(region) as region, sum(votes) as turnout
                from result join seat using (seat) where election_id = 'prev' group by 1, 2) s
          join (select unnest(['p1', 'p2', 'p3', 'p4', 'p5']) as party) k on true
          left join result r on r.election_id = s.election_id and r.seat = s.seat and r.party = k.party
          left join nowcast_change c on c.region = s.region and c.party = k.party
          where r.votes is not null or c.change is not null)"""

_STANDDOWN = """
    select x.scenario_id, m.election_id, m.seat, m.party, m.party_ord, m.votes::double as votes,
           max(case when m.party = 'p5' and standing = 0 and f5.nv is not null then m.votes::double end) over w as given5,
           max(case when m.party = 'p4' and standing = 0 and f4.nv is not null then m.votes::double end) over w as given4,
           sum(m.votes::double) over w as turnout0, f5.nv as nv5, f4.nv as nv4, t5.pct as pct5, t4.pct as pct4
    from marked m join (select distinct scenario_id, election_id from rules) x on x.election_id = m.election_id
    left join (select distinct scenario_id, election_id, not_voting as nv from rules where party_from = 'p5') f5
      on f5.scenario_id = x.scenario_id and f5.election_id = x.election_id
    left join (select distinct scenario_id, election_id, not_voting as nv from rules where party_from = 'p4') f4
      on f4.scenario_id = x.scenario_id and f4.election_id = x.election_id
    left join rules t5 on t5.scenario_id = x.scenario_id and t5.election_id = x.election_id
         and t5.party_from = 'p5' and t5.party_to = m.party
    left join rules t4 on t4.scenario_id = x.scenario_id and t4.election_id = x.election_id
         and t4.party_from = 'p4' and t4.party_to = m.party
    window w as (partition by x.scenario_id, m.election_id, m.seat)"""

STATEMENTS = {
    "seat_turnout": "select election_id, seat, cast(sum(votes) as bigint) as turnout from result group by 1, 2",
    "seat_shares": """
        select *, 100.0::double * votes / turnout as share_pct
        from (select election_id, seat, party, votes,
                     cast(sum(votes) over (partition by election_id, seat) as bigint) as turnout from result)""",
    "winners": "select * from winners",
    "compare": f"""
        select c.view_id, c.seat, c.party, c.votes, c.prev_votes, cast(c.turnout as bigint) as turnout,
               cast(c.prev_turnout as bigint) as prev_turnout, share_pct, prev_share_pct,
               share_pct - prev_share_pct as change_pct, c.winner, s.prev_winner, c.winner <> s.prev_winner as gain
        from ({_COMPARED}) c join seat_rows s on s.view_id = c.view_id and s.seat = c.seat""",
    "seat_summary": "select * from seat_full",
    "fold_others": """
        select election_id, seat, case when party = 'p5' then 'p4' else party end as party,
               cast(sum(votes) as bigint) as votes from result group by 1, 2, 3""",
    "adjust_seats": """
        select election_id, seat, party, votes::double * case when party = 'p3' and by_election is not null
                                                        then 1.4::double else 1.0::double end as votes
        from result join seat using (seat) where by_election is null or party <> 'p5'
        union all
        select election_id, seat, 'p3', coalesce(sum(case when party = 'p5' then votes * 0.5::double end), 0)
        from result join seat using (seat) where by_election is not null
        group by 1, 2 having count(case when party = 'p3' then 1 end) = 0""",
    "overrides": """
        select * from (with swapped as (
          select case election_id when 'cur' then 'prev' else 'cur' end as election_id, seat, party, votes
          from result join seat using (seat) where by_election is not null)
        select election_id, seat, party, votes from result
        where (election_id, seat) not in (select (election_id, seat) from swapped)
        union all
        select * from swapped where (election_id, seat) in (select (election_id, seat) from result))""",
    "overrides_unmatched": """
        select * from (with swapped as (
          select case election_id when 'cur' then 'prev' else 'cur' end as election_id, seat, party, votes
          from result join seat using (seat) where by_election is not null)
        select election_id, -seat - 1 as seat, party, votes from swapped
        union all
        select * from swapped where (election_id, seat) not in (select (election_id, seat) from result))""",
    "audit_seats": """
        select 'cur' as election_id, p.seat, s.region, p.winner as current_declared, c.winner,
               p.majority as majority_declared, c.majority, coalesce(p.winner = c.winner, false) as winner_ok,
               coalesce(p.majority = c.majority, false) as majority_ok, g.region_group like 'A%' as region_ok
        from winners p join seat s using (seat) join groups g on g.region = s.region
        left join winners c on c.seat = p.seat and c.election_id = 'cur' where p.election_id = 'prev'""",
    "boundary_match": """
        select coalesce(s.name, b.name) as name, s.seat, s.region, b.info_id, b.boundary_region,
               case when b.name is null then 'seat_only' when s.name is null then 'boundary_only' else 'both' end
               as match_status
        from (select seat, name, region from seat) s
        full outer join (select s_name as name, s_suppkey as info_id, n_name as boundary_region
                         from supplier join nation on s_nationkey = n_nationkey where s_name not like '%3') b
          on b.name = s.name""",
    "winner_labels": """
        select election_id, seat, winner, case winner when 'p1' then 'Urgent' when 'p2' then 'High'
                                                      when 'p3' then 'Medium' end as winner_label from winners""",
    "normalise": """
        select election_id, seat, party, v * 100.0::double / nullif(sum(v) over (partition by election_id, seat), 0) as votes
        from (select election_id, seat, party, greatest(votes - 20.0::double, 0.0::double) as v from result)""",
    "vote_totals": f"""
        select view_id, area, party, cast(seats as bigint) as seats,
               case when party <> 'total' then cast(seats - prev_seats as bigint) end as seat_change,
               cast(votes as bigint) as votes, cast(prev_votes as bigint) as prev_votes,
               case when party <> 'total' then {_round("100.0::double * votes / all_votes", 2)} end as vote_pct,
               case when party <> 'total' then {_round(
                   _round("100.0::double * votes / all_votes", 2) + " - "
                   + _round("100.0::double * prev_votes / all_prev", 2), 2)} end as vote_pct_change
        from (select *, max(case when party = 'total' then votes end) over (partition by view_id, area) as all_votes,
                     max(case when party = 'total' then prev_votes end) over (partition by view_id, area) as all_prev
              from (select r.view_id, m.area, coalesce(r.party, 'total') as party,
                           coalesce(sum(r.votes), 0) as votes, coalesce(sum(r.prev_votes), 0) as prev_votes,
                           count(case when rn = 1 then 1 end) as seats,
                           count(case when prn = 1 and prev_votes is not null then 1 end) as prev_seats
                    from ranked r join seat s on s.seat = r.seat join area_map m on m.region = s.region
                    where turnout is not null
                    group by grouping sets ((r.view_id, m.area, r.party), (r.view_id, m.area))))
        where votes > 0""",
    "area_turnout": f"""
        select view_id, area, seats, votes, electorate, {_round("100.0::double * votes / electorate", 2)} as turnout_pct
        from (select view_id, area, count(*) as seats, cast(sum(turnout) as bigint) as votes,
                     cast(sum(electorate) as bigint) as electorate
              from seat_rows join area_map using (region) group by 1, 2)""",
    "regional_totals": """
        select t.election_id, t.region, p.party, coalesce(v.votes, 0) as votes, t.turnout,
               coalesce(v.votes, 0)::double / t.turnout as share
        from (select election_id, region, cast(sum(votes) as bigint) as turnout from result join seat using (seat)
              group by 1, 2) t
        join (select unnest(['p1', 'p2', 'p3', 'p4', 'p5']) as party) p on true
        left join (select election_id, region, party, cast(sum(votes) as bigint) as votes
                   from result join seat using (seat) group by 1, 2, 3) v
          on v.election_id = t.election_id and v.region = t.region and v.party = p.party""",
    "overall_majority": """
        select view_id, region_group, house as house_seats, n as leader_seats,
               case when 2 * n > house then winner end as leader,
               case when 2 * n > house then 2 * n - house end as overall_majority, not (2 * n > house) as hung
        from (select *, row_number() over (partition by view_id, region_group order by n desc, winner desc) as rn,
                     cast(sum(n) over (partition by view_id, region_group) as bigint) as house
              from (select view_id, region_group, winner, count(*) as n from seat_rows group by 1, 2, 3)) where rn = 1""",
    "seat_tally": """
        select view_id, region, k.party, count(case when winner = k.party
                 or (k.party = 'others' and winner not in ('p1', 'p2', 'p3')) then 1 end) as seats
        from seat_rows join (select unnest(['p1', 'p2', 'p3', 'others']) as party) k on true group by 1, 2, 3""",
    "baseline_change": """
        select view_id, region, party, cast(sum(won) as bigint) as seats, cast(sum(base) as bigint) as baseline_seats,
               cast(sum(won) - sum(base) as bigint) as seat_change
        from (select view_id, region, winner as party, 1 as won, 0 as base from seat_rows
              union all select v.view_id, s.region, s.prev_winner, 0, 1
              from seat_rows s join (select distinct view_id, region from seat_rows) v on v.region = s.region
              where s.prev_winner is not null and s.view_id = 'latest')
        group by 1, 2, 3""",
    "group_shares": "select * from group_shares",
    "filter_region_majority": """
        select view_id, seat, winner, region, majority_pct,
               coalesce(winner in ('p1', 'p2', 'p3') and majority_pct between 1 and 30 and region in
                 ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_8', 'NATION_13', 'NATION_21'), false) as filtered
        from seat_full""",
    "filter_gains": "select view_id, seat, winner, prev_winner from seat_full where winner <> prev_winner",
    "filter_by_election": "select view_id, seat, by_election from seat_full where by_election is not null",
    "expand_region": """
        select region as asked, count(*) as seats, cast(sum(electorate) as bigint) as electorate from seat group by 1
        union all select region_group, count(*), cast(sum(electorate) as bigint) from seat group by 1""",
    "battlegrounds": """
        select w.election_id, w.seat, w.turnout, w.winner as incumbent, w.winner_votes as incumbent_votes,
               r.votes as challenger_votes, 100.0::double * (w.winner_votes - r.votes) / w.turnout as lead_pct
        from winners w join result r on r.election_id = w.election_id and r.seat = w.seat and r.party = 'p2'
        where w.election_id = 'prev' and w.winner = 'p1'
              and 100.0::double * (w.winner_votes - r.votes) / w.turnout between 0 and 10""",
    "search_seats": "select seat, name, region from seat where lower(name) like '%r#00000000%'",
    "link_specs": "select * from link",
    "saved_views": """
        select l.link_id, l.view_id, s.seat from link l join seat_full s on s.view_id = l.view_id
        where l.challenger is null and (l.incumbent is null or l.incumbent = s.winner)
              and (l.region is null or l.region = lower(s.region)) and s.majority_pct between l.lo and l.hi
              and (not l.gains or s.winner <> s.prev_winner) and (not l.by_election or s.by_election is not null)
        union all
        select l.link_id, l.view_id, s.seat from link l join seat_full s on s.view_id = l.view_id
        join ranked a on a.view_id = s.view_id and a.seat = s.seat and a.party = l.incumbent
        join ranked b on b.view_id = s.view_id and b.seat = s.seat and b.party = l.challenger
        where l.challenger is not null and s.prev_winner = l.incumbent and lower(s.region) = l.region
              and 100.0::double * (a.prev_votes - b.prev_votes) / s.prev_turnout between l.lo and l.hi""",
    "stable_sort": "select view_id, seat, name, majority from seat_rows order by majority desc, name",
    "extended_seats": f"""
        select view_id, seat, {", ".join(
            _round(f"100.0::double * max(case when bucket = '{b}' then v end) / max(t)", 2) + f" as {b}_pct"
            for b in ("con", "lab", "lib", "nat", "oth"))}
        from ({_DIRECTION}) group by 1, 2""",
    "change_direction": f"""
        select view_id, seat, bucket, now as share_pct, before as prev_share_pct,
               case when now > before then 1 when now < before then -1 else 0 end as direction
        from (select view_id, seat, bucket, {_round("coalesce(100.0::double * v / t, 0)", 2)} as now,
                     {_round("coalesce(100.0::double * pv / pt, 0)", 2)} as before from ({_DIRECTION}))""",
    "seat_profile": f"""
        select view_id, seat, party, votes, share_pct, prev_share_pct,
               {_round("share_pct - prev_share_pct", 2)} as change_pct,
               cast(row_number() over (partition by view_id, seat order by share_pct desc, party_ord) as int) as place
        from (select view_id, seat, party, party_ord, votes, {_round("share_pct", 2)} as share_pct,
                     {_round("prev_share_pct", 2)} as prev_share_pct from ({_COMPARED}) where votes > 0)
        qualify share_pct > 5""",
    "choropleth_share": """
        select view_id, seat, value, max_value,
               case when filtered then least(1.0::double, coalesce(value / nullif(max_value, 0), 0.0::double))
                    else 0.0::double end as intensity, 'plus' as sign_class
        from (select *, least(max(case when filtered then value end) over (partition by view_id), 0.6::double) as max_value
              from (select s.view_id, s.seat, coalesce(r.votes::double / s.turnout, 0.0::double) as value,
                           s.majority_pct between 0 and 20 as filtered
                    from seat_full s left join ranked r on r.view_id = s.view_id and r.seat = s.seat and r.party = 'p1'))""",
    "choropleth_change": """
        select *, case when intensity < 0 then 'minus' else 'plus' end as sign_class
        from (select view_id, seat, value, max_value, greatest(-1.0::double, least(1.0::double,
                        coalesce(value / nullif(max_value, 0), 0.0::double))) as intensity
              from (select *, least(max(abs(value)) over (partition by view_id), 0.6::double) as max_value
                    from (select s.view_id, s.seat, coalesce(r.votes::double / s.turnout, 0.0::double)
                                 - coalesce(r.prev_votes::double / s.prev_turnout, 0.0::double) as value
                          from seat_full s left join ranked r on r.view_id = s.view_id and r.seat = s.seat and r.party = 'p2')))""",
    "choropleth_max": """
        select s.view_id, least(max(abs(coalesce(r.votes::double / s.turnout, 0.0::double)
                                        - coalesce(r.prev_votes::double / s.prev_turnout, 0.0::double))), 0.6::double) as max_value
        from seat_full s left join ranked r on r.view_id = s.view_id and r.seat = s.seat and r.party = 'p3' group by 1""",
    "referendum_filter": """
        select seat, region, winner2015, current, leave, remain from referendum
        where leave between 45 and 60 and current = 'leave' and winner2015 in ('p1', 'p2', 'p3', 'p4')""",
    "referendum_tally": """
        select region, count(*) as total, count(case when current = 'remain' then 1 end) as remain_seats,
               count(case when current = 'leave' then 1 end) as leave_seats from referendum group by 1""",
    "referendum_intensity": """
        select seat, current, leave between 45 and 100 as filtered,
               case when leave between 45 and 100 then (20.0::double / 3.0::double)
                 * (case when current = 'leave' then leave else remain end / 100.0::double - 0.5::double)
                 else 0.0::double end as intensity from referendum""",
    "poll_rows": "select * from poll",
    "poll_overlaps": "select code, company, fieldwork_date, area, party, cast(n as bigint) as n, cast(total as bigint) as total from corrected",
    "poll_weights": f"""
        select code, company, fieldwork_date, area, party, fraction, {_scaled("weight", "1e9")} as weight_e9 from weighted""",
    "poll_swing": """
        select code, company, fieldwork_date, area, party, fraction, area_share, fraction - area_share as swing
        from fractions join area_old using (company, area, party)""",
    "poll_areas": """
        select company, region, party, count(*) as n_polls, cast(sum(n) as bigint) as n
        from poll join crosswalk using (company, area) group by 1, 2, 3""",
    "unmatched_areas": "select distinct company, area from poll where company = 'c7'",
    "tracker_polls": """
        select case when company in ('c1', 'c2', 'c4') then company when company = 'c3' then 'c2' else 'others' end
               as shown_company, count(distinct code) as n_polls, cast(sum(n) as bigint) as n
        from poll where code not in (9, 18) and company <> 'c7' group by 1""",
    "regional_blend": f"""
        select region, party, old_share, {_scaled("estimate", "1e6")} as estimate_e6, had_polls from estimates""",
    "regional_change": f"""
        select region, party, had_polls, {_scaled("new_share", "1e9")} as new_share_e9,
               {_scaled("case when old_share <> 0 then new_share - old_share end", "1e9")} as change_e9,
               {_scaled("case when old_share <> 0 then new_share / old_share end", "1e9")} as relative_e9
        from (select *, case when had_polls then greatest(estimate, 0)
                        / sum(greatest(estimate, 0)) over (partition by region, had_polls) else old_share end as new_share
              from estimates)""",
    "nowcast_swing": f"""
        select 'prev' as election_id, region, party, {_scaled("change", "1e9")} as change_e9 from nowcast_change""",
    "nowcast_history": f"""
        select * from (with days as (
          select cast(unnest(generate_series(date '2024-01-01', date '2024-02-01', interval 1 day)) as date) as as_of
        ), held as (
          select election_id, region, party, cast(sum(votes) as bigint) as votes from result join seat using (seat) group by 1, 2, 3
        ), before as (
          select r.election_id, r.region, p.party, coalesce(v.votes, 0) as votes, r.turnout,
                 coalesce(v.votes, 0)::double / r.turnout as share
          from (select election_id, region, cast(sum(votes) as bigint) as turnout from held group by 1, 2) r
          join (select unnest(['p1', 'p2', 'p3', 'p4', 'p5']) as party) p on true
          left join held v on v.election_id = r.election_id and v.region = r.region and v.party = p.party
        ), area_before as (
          select election_id, company, area, party, sum(votes)::double / sum(turnout) as area_share
          from before join crosswalk using (region) group by 1, 2, 3, 4
        ), aged as (
          select c.company, c.area, c.party, d.as_of, case when c.total = 0 then null else c.n::double / c.total end as fraction,
                 coalesce(fixed_weight, base_weight * pow(0.7::double, d.as_of - c.fieldwork_date)) as weight
          from corrected c join days d on c.fieldwork_date <= d.as_of join pollster using (company)
        ), seen as (
          select b.election_id, w.as_of, x.region, w.party, sum(w.weight * (b.share + w.fraction - a.area_share)) as estimate
          from aged w join crosswalk x using (company, area)
          join before b on b.region = x.region and b.party = w.party
          join area_before a on a.election_id = b.election_id and a.company = w.company and a.area = w.area and a.party = w.party
          where w.fraction is not null group by 1, 2, 3, 4
        ), now as (
          select b.election_id, d.as_of, b.region, b.party, b.share as old_share, s.estimate, s.estimate is not null as had_polls
          from before b join days d on true left join seen s
            on s.election_id = b.election_id and s.as_of = d.as_of and s.region = b.region and s.party = b.party)
        select election_id, as_of, region, party, had_polls,
               {_scaled("case when old_share <> 0 then new_share - old_share end", "1e9")} as change_e9
        from (select *, case when had_polls then greatest(estimate, 0)
                        / sum(greatest(estimate, 0)) over (partition by election_id, as_of, region, had_polls) else old_share end as new_share
              from now))""",
    "project_seats": f"""
        select election_id, seat, region, cast(turnout as bigint) as turnout, winner, winner_final,
               max(case when vrn = 1 then votes end) over w - coalesce(max(case when vrn = 2 then votes end) over w, 0)
               as majority, party, votes
        from (select *, max(case when vrn = 1 then party end) over (partition by election_id, seat) as winner_final
              from (select *, row_number() over (partition by election_id, seat order by votes desc, party_ord) as vrn
                    from (select *, cast(round_even(drawn / sum(drawn) over (partition by election_id, seat) * turnout, 0)
                                         as bigint) as votes,
                                 first_value(party) over (partition by election_id, seat
                                   order by case when in_seat then raw end desc nulls last, party_ord) as winner
                          from ({_PROJECTED}))))
        window w as (partition by election_id, seat)""",
    "validate_inputs": "select * from accepted",
    "validate_inputs_rejected": """
        select distinct scenario_id, view_id, region_group, sum_h / 100.0::double as sum_pct
        from clean_inputs where sum_h > 10000""",
    "scenario_change": f"""
        select scenario_id, view_id, region_group, region, party, {_scaled("change", "1e9")} as change_e9 from changes""",
    "project_inputs": f"""
        select scenario_id, view_id, seat, region, party, winner, {_scaled("pct * turnout / 100.0::double", "1e3")} as votes_e3,
               cast(floor((max(case when rn = 1 then pct end) over w - coalesce(max(case when rn = 2 then pct end) over w, 0))
                          * turnout / 100.0::double) as bigint) as majority
        from (select *, first_value(party) over (partition by scenario_id, view_id, seat order by pct desc, party_ord) as winner,
                     row_number() over (partition by scenario_id, view_id, seat order by pct desc, party_ord) as rn
              from (select *, moved / (sum(moved) over (partition by scenario_id, view_id, seat order by party
                                         rows between unbounded preceding and unbounded following) / 100.0::double) as pct
                    from (select c.scenario_id, c.view_id, s.seat, s.region, s.turnout, c.party,
                                 cast(substr(c.party, 2, 1) as int) as party_ord,
                                 greatest(coalesce(100.0::double * r.prev_votes / s.prev_turnout, 0) + c.change,
                                          0.1::double * coalesce(100.0::double * r.prev_votes / s.prev_turnout, 0)) as moved
                          from changes c join seat_rows s on s.view_id = c.view_id and s.region = c.region
                          left join pair r on r.view_id = s.view_id and r.seat = s.seat and r.party = c.party)))
        window w as (partition by scenario_id, view_id, seat) qualify pct > 0""",
    "unchanged_seats": """
        select x.scenario_id, s.view_id, s.seat, s.region, s.winner, s.majority, r.party, r.votes::double as votes
        from seat_rows s join (select distinct scenario_id, view_id from inputs) x on x.view_id = s.view_id
        join pair r on r.view_id = s.view_id and r.seat = s.seat and r.votes is not null
        where not exists (select 1 from changes c where c.scenario_id = x.scenario_id and c.view_id = s.view_id
                          and c.region = s.region)""",
    "mark_standing": "select election_id, seat, party, votes, standing from marked",
    "validate_rules": "select * from rules",
    "validate_rules_rejected": "select distinct scenario_id, election_id, party_from, not_voting from rules_all where not_voting < 0",
    "redistribute": f"""
        select scenario_id, election_id, seat, turnout, party, votes,
               max(case when rn = 1 then party end) over w as winner,
               max(case when rn = 1 then votes end) over w - coalesce(max(case when rn = 2 then votes end) over w, 0) as majority
        from (select scenario_id, election_id, seat, party, v2 as votes,
                     case when given4 is null then t1 else floor(t1 - given4 * nv4 / 100.0::double + 0.5::double) end as turnout,
                     row_number() over (partition by scenario_id, election_id, seat order by v2 desc, party_ord) as rn
              from (select *, case when given4 is null or pct4 is null then v1
                                   else floor(v1 + pct4 * given4 / 100.0::double + 0.5::double) end as v2
                    from (select *, case when given5 is null or pct5 is null then votes
                                         else floor(votes + pct5 * given5 / 100.0::double + 0.5::double) end as v1,
                                 case when given5 is null then turnout0
                                      else floor(turnout0 - given5 * nv5 / 100.0::double + 0.5::double) end as t1
                          from ({_STANDDOWN})))
              where not (party = 'p5' and given5 is not null) and not (party = 'p4' and given4 is not null))
        window w as (partition by scenario_id, election_id, seat)""",
    "poll_points": "select * from points",
    "filter_points": """
        select * from points where fieldwork_date between date '2024-01-05' and date '2024-01-20'
               and company in ('c1', 'c2', 'c3')""",
    "moving_average": f"""
        select code, company, fieldwork_date, party, pct, {_scaled("tenths / n / 10.0::double", "1e6")} as moving_e6
        from (select *, sum(floor(pct * 10 + 0.5)) over w as tenths, count(*) over w as n
              from points where fieldwork_date between date '2024-01-01' and date '2024-12-31'
              window w as (partition by party order by fieldwork_date, code rows between 11 preceding and current row))""",
    "companies": "select distinct company from points",
    "latest_poll": """
        select code, company from poll where code not in (247, 246) order by code desc limit 1""",
    "latest_date": "select greatest(max(fieldwork_date), date '2015-05-01') as latest_date from poll",
    "model_series": """
        select date, party, seats, 326 as majority_line from history
        where date between date '1995-01-01' and date '1999-12-31'""",
    "upsert_snapshot": """
        select date, party, seats from history where date not in (select date from recount)
        union all select date, party, seats from recount""",
    "card_mode": "select mode, cost_bucket, count(*) as n_cards from card group by 1, 2",
    "card_facets": """
        select card_id, name, card_class, type, rarity, race, mode, cost_bucket from card
        where rarity in ('R0', 'R1') and race in ('T0', 'T1') and cost_bucket in ('0', '2', '4', '7plus')
              and list_contains(mechanics, 'ring')""",
    "card_sort": "select card_id, name, cost from card where mode = 'standard' order by name, card_id",
    "first_two_sentences": f"select conv_id, turn, {_first_sentences('text')} as start from conversations",
    "clean_facts": "select fact_id, cleaned, kept from judged",
    "fact_groups": """
        select year, era, timeframe_type, count(event) as n_facts from fact group by 1, 2, 3 having count(event) >= 3""",
    "fact_lists": """
        select year, era, timeframe_type, count(event) as n_facts, count(*) as n_listed, min(event) as first,
               max(event) as last from fact group by 1, 2, 3 having count(event) >= 3""",
    "fact_report": """
        select era, timeframe_type, count(*) as n_raw, count(case when kept then 1 end) as n_kept,
               count(case when not kept then 1 end) as n_filtered,
               100.0::double * count(case when kept then 1 end) / count(*) as kept_pct from judged group by 1, 2""",
    "excluded_years": """
        select year, era, timeframe_type, count(case when kept then 1 end) as n_kept from judged
        group by 1, 2, 3 having count(case when kept then 1 end) between 1 and 2""",
    "sample_facts": """
        select fact_id, year, era, draw_no
        from (select *, cast(row_number() over (partition by year, era, timeframe_type
                               order by md5(concat('7:', cast(fact_id as varchar))), fact_id) as int) as draw_no from fact)
        where draw_no <= 5""",
    "pick_challenges": """
        select year, era, timeframe_type, count(event) as n_facts from fact group by 1, 2, 3 having count(event) >= 3
        order by md5(concat('3:', cast(year as varchar), ':', era)), year, era limit 20""",
    "challenge_build": """
        select case when g.timeframe_type = 'decade' then g.bucket_start else g.year end as year, g.era, g.timeframe_type,
               g.bucket_start, g.n_facts, d.facts
        from (select *, row_number() over (partition by timeframe_type, era, bucket_start order by year) as turn
              from (select year, era, timeframe_type, count(*) as n_facts,
                           cast(case timeframe_type when 'decade' then year // 10 * 10 when 'century' then year // 100 * 100
                                else year end as int) as bucket_start
                    from judged where kept group by 1, 2, 3 having count(*) >= 3)) g
        join (select year, era, timeframe_type, string_agg(cleaned, ' | ' order by draw_no) as facts
              from (select *, row_number() over (partition by year, era, timeframe_type
                                 order by md5(concat('1:', cast(fact_id as varchar))), fact_id) as draw_no
                    from judged where kept) where draw_no <= 5 group by 1, 2, 3) d
          on d.year = g.year and d.era = g.era and d.timeframe_type = g.timeframe_type
        where g.turn = 1""",
    "timeframe_calendar": """
        select title, fallback, timeframe_type, first_year, last_year, count(*) as n_facts from fact group by 1, 2, 3, 4, 5""",
    "load_facts": f"""
        select cast(year as int) as year, era, timeframe_type, source_page, count(*) as n_facts, min(pos)['doc_id'] as first_doc, min(pos)['pos'] as first_pos,
               max(event) as last_event
        from (
          select c.year, c.era, c.timeframe_type, c.source_page, p.pos, p.event
          from (select year, era, timeframe_type, source_page,
                       row_number() over (partition by year, era order by load_order) as turn
                from (select unnest(range(first_year, last_year + 1)) as year, era, timeframe_type, source_page, load_order
                      from (select *, row_number() over (partition by era, timeframe_type, first_year order by load_order) as first_turn
                            from (select k.*, coalesce(t1.title, t2.title) as source_page
                                  from (select *, {TIMEFRAME}
                                        from (select i as load_order, cast(case when i <= 2026 then i else i - 2026 end as int) as year,
                                                     case when i <= 2026 then 'AD' else 'BC' end as era
                                              from (select unnest(range(1, 6027)) as i))) k
                                  left join (select distinct title from page_facts) t1 on t1.title = k.title
                                  left join (select distinct title from page_facts) t2 on t2.title = k.fallback
                                  where coalesce(t1.title, t2.title) is not null
                                        and not exists (select 1 from fact_base f where f.era = 'BC' and f.era = k.era and f.year = k.year)))
                      where first_turn = 1) x
                where not exists (select 1 from fact_base f where f.era = 'BC' and f.era = x.era and f.year = x.year)) c
          join page_facts p on p.title = c.source_page where c.turn = 1)
        group by 1, 2, 3, 4""",
    "score_guesses": "select game_id, attempt, distance, is_win, band from scored",
    "game_outcomes": """
        select game_id, min(case when is_win then attempt_no end) is not null as won,
               cast(coalesce(min(case when is_win then attempt_no end), max(attempt_no)) as int) as attempts_used,
               min(distance) as best_distance,
               min(case when is_win then attempt_no end) is null and max(attempt_no) = 8 as lost
        from (select *, row_number() over (partition by game_id order by attempt) as attempt_no from scored)
        where attempt_no <= 8 group by 1""",
    "seat_documents": """
        select w.election_id, cast(w.seat as varchar) as seat, r.party, r.votes, s.region, s.electorate,
               w.winner as current_declared, w.majority as majority_declared
        from winners w join seat s using (seat) join result r on r.election_id = w.election_id and r.seat = w.seat""",
    "referendum_documents": "select cast(seat as varchar) as seat, region, winner2015, current, leave, remain from referendum",
    "poll_file_rows": "select * from poll",
    "tracker_documents": """
        select fieldwork_date as date, party, count(*) as n_points, max(pct) as max_pct,
               cast(case when party = 'p1' then count(*) end as bigint) as model_seats from points group by 1, 2""",
}

VIEWS["page_facts"] = """
    select case when source = 'src0' and fallback is not null then fallback else title end as title,
           {'doc_id': doc_id, 'pos': cast(pos as int)} as pos, event
    from (select *, %s from (select doc_id, source, pos, event, cast(1 + (doc_id * 3) %% 4000 as int) as year,
                                    case when doc_id %% 2 = 0 then 'BC' else 'AD' end as era from lines))""" % TIMEFRAME
VIEWS["scored"] = """
    select game_id, attempt, distance, is_win,
           case when is_win then 'correct' when distance <= 2 then '1-2' when distance <= 10 then '3-10'
                when distance <= 40 then '11-40' when distance <= 200 then '41-200' when distance <= 1000 then '200-1000'
                else 'over 1000' end as band
    from (select *, (timeframe_type = 'year' and distance = 0)
                    or (timeframe_type = 'decade' and distance < 10 and abs(aim) // 10 = abs(shot) // 10)
                    or (timeframe_type = 'century' and distance < 100) as is_win
          from (select *, cast(abs(aim - shot) - case when (aim < 0) <> (shot < 0) then 1 else 0 end as int) as distance
                from (select user_id as game_id, event_id as attempt,
                             case when user_id % 3 = 0 then -1 else 1 end * (1 + (user_id * 37) % 2000) as aim,
                             case when event_id % 4 = 0 then -1 else 1 end
                               * (1 + cast(floor(value * 10) as bigint) % 2000) as shot,
                             case user_id % 3 when 0 then 'century' when 1 then 'year' else 'decade' end as timeframe_type
                      from events)))"""

STATEMENTS["marked_documents"] = STATEMENTS["redistribute"]
STATEMENTS["challenge_files"] = f"""
        select year, era, timeframe_type, facts from ({STATEMENTS["challenge_build"]})"""
STATEMENTS["history_table"] = STATEMENTS["upsert_snapshot"]
STATEMENTS["stored_compare"] = STATEMENTS["compare"]
STATEMENTS["facts_cleaned_once"] = """
        select era, timeframe_type, count(*) as n_raw, count(case when kept then 1 end) as n_kept,
               cast(sum(length(cleaned)) as bigint) as n_letters, cast(0 as bigint) as n_added_again from judged group by 1, 2"""
STATEMENTS["fact_table"] = """
        select era, timeframe_type, count(*) as n_facts,
               cast(sum(case when era = 'BC' and year between 501 and 1000 then least(length(event), 5) else length(event) end) as bigint)
                 as n_letters from fact group by 1, 2"""
STATEMENTS["card_files"] = """
        select p_name as name, p_brand as card_class, p_type as type, concat('R', p_partkey % 5) as rarity,
               case when p_partkey % 3 = 0 then '' else concat('T', p_partkey % 3) end as race, concat('S', p_partkey % 13) as card_set,
               cast(p_size % 12 as int) as cost, array_to_string(string_split(p_name, ' '), ' ') as mechanics,
               concat('card/', p_partkey) as url from part"""
STATEMENTS["party_labels"] = """
        select election_id, l.label, cast(sum(votes) as bigint) as votes from result
        join (values ('p1', 'Labour'), ('p2', 'Conservative'), ('p3', 'Lib Dems'), ('p4', 'SNP'), ('p5', 'Reform')) l(party, label)
          using (party) group by 1, 2"""
STATEMENTS["poll_table"] = """
        select code, company, cast(fieldwork_date - to_months(12 * k) as date) as fieldwork_date, area, party,
               case when k = 3 then 2 * n when k = 5 and day(fieldwork_date) < 9 then n + 1 else n end as n, total
        from (select *, cast(substr(company, 2, 1) as int) as k from poll) where k between 2 and 5"""
STATEMENTS["poll_file_rejects"] = """
        select cast(code as varchar) as code, area as region, fieldwork_date, party as cell, concat(n, ' ca.') as value,
               'not a whole number' as reason from poll where company = 'c2' and party <> 'p4'
        union all
        select distinct cast(code as varchar), area, fieldwork_date, 'date', '2024-2-31', 'not a date' from poll where company = 'c6'"""
STATEMENTS["challenge_counts"] = f"""
        select timeframe_type, count(*) as n_challenges from ({STATEMENTS["challenge_build"]}) group by 1"""

_EXTRACT = {
    "extract_facts": ("p", 25, ["the", "de", "der"], ["zz"]),
    "extract_list_items": ("li", 3, None, []),
}
for _name, (_tag, _min_len, _include, _exclude) in _EXTRACT.items():
    _source = _sub(_sub(_sub("html", r"<script\b.*?</script>", "", "gis"), r"<style\b.*?</style>", "", "gis"),
                   r"<!--.*?-->", "", "gs")
    _heading = "lower(" + _plain_text(r"regexp_extract(section, '(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>', 1)") + ")"
    _wanted = " or ".join(f"contains({_heading}, '{w}')" for w in _include) if _include else "true"
    _unwanted = " or ".join(f"contains({_heading}, '{w}')" for w in _exclude) if _exclude else "false"
    _cut = _sub("html", r"<(h[1-6])\b", r"#%#<\1", "gi")
    _opens = f"({_unwanted})" if _include is None else f"({_wanted}) and not ({_unwanted})"
    _lists = "ul|ol" if _tag == "li" else "no-list"
    _held = """exists (select 1 from marked a where a.page_id = k.page_id and a.opens and a.sno <= k.sno and not exists (
                 select 1 from marked b where b.page_id = a.page_id and b.sno > a.sno and b.sno <= k.sno and b.level <= a.level))"""
    STATEMENTS[_name] = rf"""
        select * from (with marked as (
          select page_id, sno, section, {_opens} as opens,
                 coalesce(try_cast(regexp_extract(section, '(?i)^<h([1-6])', 1) as int), 9) as level
          from (select page_id, unnest(range(1, len(sections) + 1)) as sno, unnest(sections) as section
                from (select page_id, string_split({_cut}, '#%#') as sections from (select page_id, {_source} as html from pages)))
        ), tokens as (
          select *, s - least(0, min(s) over (partition by page_id, sno order by ino)) + case when kind = 'out' then 1 else 0 end as depth
          from (select *, sum(case kind when 'in' then 1 when 'out' then -1 else 0 end) over (partition by page_id, sno order by ino) as s
                from (select page_id, sno, ino, token,
                             case when regexp_matches(token, '(?i)^<{_tag}(\s[^>]*)?>') then 'item'
                                  when regexp_matches(token, '(?i)^</{_tag}(\s[^>]*)?>') then 'end'
                                  when regexp_matches(token, '(?i)^<({_lists})(\s[^>]*)?>') then 'in'
                                  when regexp_matches(token, '(?i)^</({_lists})(\s[^>]*)?>') then 'out' else 'text' end as kind
                      from (select page_id, sno, unnest(range(1, len(l) + 1)) as ino, unnest(l) as token
                            from (select page_id, sno, string_split({_sub("section", rf"(</?(?:{_tag}|{_lists})(?:\s[^>]*)?>)", r"#%#\1", "gi")}, '#%#') as l
                                  from marked k where {"not " if _include is None else ""}{_held}))))
        ), items as (
          select o.page_id, o.sno, o.ino, coalesce(min(c.ino), 1000000000) as ends
          from tokens o left join tokens c on c.page_id = o.page_id and c.sno = o.sno and c.ino > o.ino
               and c.kind in ('item', 'end', 'out') and c.depth = o.depth
          where o.kind = 'item' and o.depth >= {1 if _tag == "li" else 0} group by 1, 2, 3
        ), texts as (
          select i.page_id, i.sno, i.ino, string_agg(t.token, '' order by t.ino) as html
          from items i join tokens t on t.page_id = i.page_id and t.sno = i.sno and t.ino >= i.ino and t.ino < i.ends group by 1, 2, 3
        )
        select page_id, cast(row_number() over (partition by page_id order by place) - 1 as int) as pos, event
        from (select page_id, event, min({{'s': sno, 'i': ino}}) as place
              from (select page_id, sno, ino, regexp_replace(raw, '\[[0-9]+\]|\[edit\]', '', 'g') as event
                    from (select page_id, sno, ino, {_plain_text("html")} as raw from texts) where not starts_with(raw, '^'))
              where length(event) > {_min_len} group by 1, 2))"""


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in STATEMENTS.items()}
