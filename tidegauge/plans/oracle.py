"""The same queries in DuckDB SQL, written independently: window functions and plain
aggregates over the given tables, without the engine's blocks or passes."""

from __future__ import annotations

BASE = r"""
with logged as (
  select cast(l_orderkey as varchar) as request_id,
         ((l_linenumber * 1000 + l_partkey % 1000) * 1000000 + l_suppkey) * 100 + cast(l_quantity as bigint) as seq,
         cast(l_linenumber * 1000 + l_partkey % 1000 as double) / 4099 as arrival_s,
         l_linenumber % 5 = 4 and l_partkey % 4 = 0 as marker,
         case when l_linenumber = 1 and l_returnflag = 'R' then ''
              else l_returnflag || cast(l_suppkey as varchar) || ' ' end as content,
         l_returnflag = 'A' as has_usage,
         case when l_returnflag = 'A' then (l_partkey * 37) % 1500 end as u_prompt,
         case when l_returnflag = 'A' and l_linestatus = 'O' then cast(l_quantity as bigint) * 10 end as u_completion,
         case when l_returnflag = 'A' and l_discount = 0 then 16 end as u_cached,
         case when l_returnflag = 'A' and l_suppkey % 10 = 0 then l_suppkey end as u_reasoning
  from lineitem),
-- A stream ends at its first marker, and the marker itself holds nothing.
stopped as (select request_id, min(seq) as stop from logged where marker group by request_id),
chunks as (
  select l.request_id, seq, arrival_s, case when not marker then content end as content, has_usage and not marker as has_usage,
         case when not marker then u_prompt end as u_prompt, case when not marker then u_completion end as u_completion,
         case when not marker then u_cached end as u_cached, case when not marker then u_reasoning end as u_reasoning
  from logged l left join stopped s using (request_id) where stop is null or seq <= stop),
texts as (select * from chunks where content <> ''),
finals as (
  select cast(o_orderkey as varchar) as request_id,
         2.0::double + cast(o_custkey % 512 as double) / 257 as e2e,
         o_orderkey % 89 <> 0 or stop is not null as done,
         o_orderkey % 83 <> 0 or stop is not null as parse_ok,
         case when o_orderkey % 97 = 0 then 429 when o_orderkey % 101 = 0 then 503 else 200 end as status_code,
         case when o_orderkey % 53 = 0 then 'timeout' when o_orderkey % 59 = 0 then 'protocol'
              when o_orderkey % 61 = 0 then 'connection' end as error_kind
  from orders left join stopped on request_id = cast(o_orderkey as varchar)),
outcomes as (
  select *, case when error_kind = 'timeout' then 'timeout'
                 when error_kind = 'protocol' then 'malformed_stream'
                 when error_kind is not null then 'connection_error'
                 when status_code = 429 then 'rate_limited'
                 when status_code <> 200 then 'connection_error'
                 when done and parse_ok then 'success'
                 else 'malformed_stream' end as outcome
  from finals),
requests as (
  select cast(o_orderkey as varchar) as request_id,
         'run-' || cast(case when o_custkey % 3 = 0 then 0 else o_custkey % 5 end as varchar) as run_id,
         cast(power(4, o_orderkey % 4) as double) as level_or_rate,
         (epoch(o_orderdate) - 694224000) / 86400 + cast(o_orderkey % 1024 as double) / 1024 as t_start,
         'prompt-' || cast(o_custkey as varchar) as prompt_id
  from orders),
runs as (
  select 'run-' || cast(r_regionkey as varchar) as run_id, r_regionkey as k, r_name as model_name,
         case when r_regionkey = 4 then 'open' else 'closed' end as mode,
         case r_regionkey when 0 then 'interactive' when 1 then 'relaxed' when 2 then 'strict'
                          when 3 then 'unknown' else 'first-token' end as slo_profile,
         case when r_regionkey = 3 then 1800.0 else 240.0 end as warmup_s,
         case when r_regionkey = 3 then 2400.0 else 2160.0 end as steady_end_s,
         case when r_regionkey = 1 then 100000 else 30 end as min_samples,
         r_regionkey % 2 = 0 as cache_busting,
         (case when r_regionkey % 2 = 0 then 'acme' else 'globex' end) || '/' || lower(r_name) as model,
         r_regionkey % 2 = 0 as supports_tools,
         r_regionkey < 2 as supports_vision,
         case when r_regionkey <> 3 then 0.25::double * (r_regionkey + 1) end as price_input,
         0.5::double * (r_regionkey + 1) as price_output,
         'library-' || cast(r_regionkey % 3 as varchar) as library
  from region),
run_levels as (
  select run_id, unnest([1.0, 4.0, 16.0, 64.0, 256.0])::double as level_or_rate, k from runs),
configured as (select * from run_levels where not (run_id = 'run-1' and level_or_rate = 64)),
slo as (
  select * from (values ('relaxed', 1500.0::double, 40.0::double, 3500.0::double), ('strict', 300.0, 5.0, 2500.0),
                        ('first-token', 400.0, null, null), ('batch', 900.0, 60.0, null), ('bulk', 1000.0, null, 9000.0),
                        ('interactive', 500.0, 50.0, 5000.0))
           as t(slo_profile, ttft_ms, tpot_ms, e2e_ms)),
prompts as (
  select 'prompt-' || cast(p_partkey as varchar) as id, p_partkey, p_size, p_name, p_brand,
         'library-' || cast(p_size % 3 as varchar) as library,
         coalesce(case p_size % 6 when 0 then 'coding' when 1 then 'synthesis' when 2 then 'tool-use'
                                  when 3 then 'vision' when 4 then 'general' end, 'general') as category,
         coalesce(case p_size % 5 when 0 then '' when 1 then 'short' when 2 then 'medium' when 3 then 'long' end,
                  'short') as isl_bucket,
         case when p_size % 7 = 0 then '  ' when p_size % 11 <> 0 then p_name end as expected_output
  from part where p_size % 17 <> 16 and p_size % 19 <> 18),
gaps as (
  select request_id, arrival_s, lag(arrival_s) over w as since, arrival_s - lag(arrival_s) over w as gap,
         row_number() over w as rn
  from texts window w as (partition by request_id order by arrival_s)),
itl as (
  select request_id, max(case when rn = 2 then gap end) as tt2t, avg(gap) as itl_mean, quantile_cont(gap, 0.5) as itl_p50,
         quantile_cont(gap, 0.95) as itl_p95, quantile_cont(gap, 0.99) as itl_p99, max(gap) as itl_max
  from gaps where gap is not null group by request_id),
facts as (
  select request_id, min(arrival_s) filter (content <> '') as ttft,
         count(*) filter (content <> '') as deltas, count(*) filter (has_usage) as usages,
         arg_max(u_prompt, seq) filter (u_prompt is not null) as l_prompt,
         arg_max(u_completion, seq) filter (u_completion is not null) as l_completion,
         arg_max(u_cached, seq) filter (u_cached is not null) as l_cached,
         arg_max(u_reasoning, seq) filter (u_reasoning is not null) as l_reasoning
  from chunks group by request_id),
joined as (
  select r.*, o.e2e, o.outcome, o.error_kind, o.status_code as raw_status, o.outcome = 'success' as ok,
         u.mode, u.model, u.cache_busting, u.price_input, u.price_output, u.warmup_s, u.steady_end_s,
         p.category as p_category, p.isl_bucket as p_bucket, p.expected_output,
         f.ttft as f_ttft, coalesce(f.deltas, 0) as deltas, coalesce(f.usages, 0) as usages,
         l_prompt, l_completion, l_cached, l_reasoning, i.* exclude (request_id)
  from requests r join outcomes o using (request_id) join runs u using (run_id)
       left join prompts p on p.id = r.prompt_id left join facts f using (request_id) left join itl i using (request_id)),
tokens as (
  select *, case when ok then f_ttft end as ttft,
         case when not ok then 0 when usages = 0 then deltas else coalesce(l_completion, 0) end as output_tokens,
         case when ok then coalesce(l_prompt, 0) else 0 end as prompt_tokens,
         case when ok then coalesce(l_cached, 0) else 0 end as cached_tokens,
         case when ok then coalesce(l_reasoning, 0) else 0 end as reasoning_tokens,
         ok and usages = 0 as usage_incomplete
  from joined),
records as (
  select run_id, model, mode, level_or_rate,
         case when t_start - 1096 < warmup_s then 'warmup' when t_start - 1096 < steady_end_s then 'steady'
              else 'cooldown' end as phase,
         request_id, prompt_id, coalesce(p_category, 'general') as category, t_start, ttft,
         case when ok then tt2t end as tt2t, e2e,
         case when output_tokens > 1 then (e2e - ttft) / (output_tokens - 1) end as tpot,
         case when output_tokens > 0 then e2e / output_tokens end as normalized_latency,
         output_tokens, prompt_tokens, cached_tokens, reasoning_tokens, usage_incomplete,
         coalesce(nullif(coalesce(p_bucket, 'short'), ''),
                  case when prompt_tokens < 256 then 'short' when prompt_tokens < 1024 then 'medium' else 'long' end)
           as isl_bucket,
         case when output_tokens < 32 then 'short' when output_tokens < 256 then 'medium' else 'long' end as osl_bucket,
         (prompt_tokens * price_input + output_tokens * price_output) / 1000000 as cost_usd,
         outcome, case when error_kind is null then raw_status else 0 end as status_code,
         case when ok then null when error_kind is not null then error_kind
              when outcome = 'malformed_stream' then 'malformed stream'
              else 'HTTP ' || cast(raw_status as varchar) end as error,
         ok and cached_tokens > 0 and cache_busting as cache_violation, expected_output,
         case when ok then itl_mean end as itl_mean, case when ok then itl_p50 end as itl_p50,
         case when ok then itl_p95 end as itl_p95, case when ok then itl_p99 end as itl_p99,
         case when ok then itl_max end as itl_max
  from tokens),
ss as (select * from records where phase = 'steady' and outcome = 'success'),
pool as (select s.run_id, s.level_or_rate, g.gap from gaps g join ss s using (request_id) where g.gap is not null),
scores as (
  select cast(event_id as varchar) as request_id,
         case when event_type <> 'error' then 'judged' else 'eval_skipped' end as status,
         cast(json_extract_string(props, '$.k') as double) / 100 as k,
         event_type
  from events),
scored as (
  select r.* exclude (expected_output), eligible,
         case when not eligible then 'skipped_no_expected' else coalesce(status, 'eval_dropped') end as eval_status,
         case when eligible and event_type = 'view' then k end as sim_score,
         case when eligible and event_type <> 'error' then k end as quality_score,
         case when eligible and event_type <> 'error' then k >= 0.5 end as quality_pass,
         case when eligible and event_type not in ('error', 'view') then case when k >= 0.5 then 'pass' else 'fail' end end
           as judge_verdict,
         case when eligible and event_type not in ('error', 'view') then event_type end as judge_reason
  from (select *, outcome = 'success' and coalesce(trim(expected_output), '') <> '' as eligible from records) r
       left join scores using (request_id)),
sss as (select * from scored where phase = 'steady' and outcome = 'success'),
targets as (select u.run_id, s.* exclude (slo_profile) from runs u left join slo s using (slo_profile)),
slo_rows as (
  select r.*, ttft_ms, tpot_ms, e2e_ms,
         (ttft_ms is null or coalesce(ttft * 1000 <= ttft_ms, false))
         and (tpot_ms is null or coalesce(tpot * 1000 <= tpot_ms, false))
         and (e2e_ms is null or coalesce(e2e * 1000 <= e2e_ms, false)) as meets_slo
  from records r left join targets using (run_id)),
rel as (
  select run_id, level_or_rate, count(*) filter (phase = 'steady') as steady_samples,
         count(*) filter (phase = 'steady' and outcome = 'success') as completed,
         count(*) filter (phase = 'steady' and outcome <> 'success') as failed,
         count(*) filter (phase = 'steady' and outcome = 'rate_limited') as rate_limited
  from records group by all),
thr as (
  select run_id, level_or_rate, count(*) as completed, greatest(max(t_start + e2e) - min(t_start), 0) as w,
         sum(output_tokens) as so, sum(output_tokens + prompt_tokens) as st,
         coalesce(avg(case when e2e > ttft and output_tokens > 0 then output_tokens / (e2e - ttft) end), 0) as per_user,
         count(*) filter (usage_incomplete) as ui, count(*) filter (cache_violation) as cv, sum(cost_usd) as cost
  from ss group by all),
good as (
  select run_id, level_or_rate, count(*) filter (meets_slo) as goodput_count
  from slo_rows where phase = 'steady' and outcome = 'success' group by all),
metric_rows as (
  select run_id, level_or_rate, 'ttft' as metric, ttft as v from ss union all
  select run_id, level_or_rate, 'tpot', tpot from ss union all
  select run_id, level_or_rate, 'e2e', e2e from ss union all
  select run_id, level_or_rate, 'input_tokens', prompt_tokens from ss union all
  select run_id, level_or_rate, 'output_tokens', output_tokens from ss),
stats_of as (
  select run_id, level_or_rate, metric, count(v) as samples, avg(v) as mean, min(v) as min, max(v) as max,
         stddev_pop(v) as std, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.95) as p95,
         quantile_cont(v, 0.99) as p99, case when count(v) >= 1000 then quantile_cont(v, 0.999) end as p999
  from (select * from metric_rows union all select run_id, level_or_rate, 'itl', gap from pool)
  where v is not null group by all),
levels as (
  select c.run_id, c.level_or_rate, u.mode, u.model, u.min_samples,
         u.price_input is not null and u.price_output is not null as priced,
         coalesce(rel.steady_samples, 0) as steady_samples, coalesce(rel.completed, 0) as completed,
         coalesce(rel.failed, 0) as failed, coalesce(rel.rate_limited, 0) as rate_limited,
         coalesce(w, 0) as w, coalesce(so, 0) as so, coalesce(st, 0) as st, coalesce(per_user, 0) as per_user,
         coalesce(ui, 0) as ui, coalesce(cv, 0) as cv, coalesce(cost, 0) as cost,
         coalesce(goodput_count, 0) as goodput_count
  from configured c join runs u using (run_id) left join rel using (run_id, level_or_rate)
       left join thr using (run_id, level_or_rate) left join good using (run_id, level_or_rate)),
turns as (
  select *, max(case when role = 'user' and text is not null then turn end) over (partition by conv_id) as last_turn
  from conversations),
replies as (
  select event_id, cast(event_id as varchar) as request_id, event_type, user_id, json_extract_string(props, '$.k') as k,
         case event_id % 3 when 0 then 'score' when 1 then 'binary' else 'three_level' end as rubric,
         case when event_id % 13 = 12 then 99 else event_id % 12 end as form
  from events),
verdicts as (
  select *, case form when 0 then '' when 1 then '' when 2 then '' when 3 then '' when 4 then ''
                      when 5 then cast(cast('0.' || k as double) as varchar)
                      when 6 then case when user_id % 2 = 0 then 'PASS' else 'partial' end
                      when 7 then 'Correct' when 8 then 'yes' when 9 then 'no idea about ' || event_type
                      when 10 then '' else '' end as verdict,
            case form when 0 then event_type when 1 then 'high' when 2 then '' when 3 then 'word' when 4 then ''
                      when 5 then cast(cast('0.' || k as double) as varchar) when 6 then event_type when 7 then 'Correct' when 8 then 'yes'
                      when 9 then 'no idea about ' || event_type when 10 then '' else '' end as verdict_reason,
            case form when 0 then cast('0.' || k as double) when 1 then 1.0 when 5 then cast('0.' || k as double)
                      when 10 then 0.25 else 0.0 end as score,
            case form when 0 then event_type when 1 then 'high' when 3 then 'word' when 5 then '0.' || k
                      when 6 then event_type when 8 then 'yes' when 9 then 'no idea about ' || event_type
                      else '' end as score_reason
  from replies),
normal as (
  select *, case when rubric = 'three_level' then
                   case when lower(verdict) in ('correct', 'partial', 'incorrect') then lower(verdict) else 'incorrect' end
                 when lower(verdict) in ('pass', 'fail') then lower(verdict)
                 when lower(verdict) in ('yes', 'true', 'correct') then 'pass' else 'fail' end as norm
  from verdicts),
timed as (
  select o_orderkey as n, cast(o_orderkey as varchar) as request_id,
         'run-' || cast(case when o_custkey % 3 = 0 then 0 else o_custkey % 5 end as varchar) as run_id,
         cast(power(4, o_orderkey % 4) as double) as level_or_rate,
         case o_orderkey % 10 when 0 then 'warmup' when 9 then 'cooldown' else 'steady' end as phase,
         case when o_orderkey % 97 = 0 then 'rate_limited' when o_orderkey % 101 = 0 then 'timeout' else 'success' end
           as outcome,
         2.0::double + cast(o_custkey % 512 as double) / 257 as e2e,
         o_orderkey % 7 <> 0 as eligible,
         timestamp '2024-01-01 00:00:00' + to_seconds(o_orderkey) as ts
  from orders),
mark as (select max(ts) - interval 30 seconds as wm from timed),
timed_steady as (select * from timed where phase = 'steady'),
steady_mark as (select max(ts) - interval 30 seconds as wm from timed_steady),
ok_mark as (select wm from steady_mark)
"""

E = "round({0}, 6) as {1}"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


RECORD_CHECK = (
    "run_id, request_id, phase, outcome, round(ttft, 6) as ttft, round(e2e, 6) as e2e, output_tokens, usage_incomplete, "
    "round(cost_usd, 9) as cost_usd, round(itl_p95, 6) as itl_p95"
)

STATS = ("mean", "min", "max", "std", "p50", "p90", "p95", "p99", "p999")

DERIVED = """
  case when w > 0 then so / w else 0 end as system_tok_s, case when w > 0 then st / w else 0 end as total_tok_s,
  case when w > 0 then completed / w else 0 end as rps,
  rate_limited / greatest(steady_samples, 1) as rate_limited_rate,
  case when completed > 0 then goodput_count / completed else 0 end as goodput_attainment,
  case when w > 0 then goodput_count / w else 0 end as goodput_rps,
  case when priced then cost end as total_cost_usd,
  case when priced then case when completed > 0 then cost / completed * 1000 else 0 end end as cost_per_1k_requests
"""


def _level_summary() -> str:
    metrics = ("ttft", "tpot", "e2e", "input_tokens", "output_tokens", "itl")
    cells = ", ".join(
        f"round(max(case when metric = '{m}' then s.\"{s}\" end), 6) as {m}_{s}" for m in metrics for s in STATS
    )
    return f"""
    , wide as (select run_id, level_or_rate, {cells} from stats_of s group by all)
    select run_id, level_or_rate, mode, model, steady_samples, completed, failed, rate_limited, completed as latency_sample_count,
      round(w, 6) as steady_window_s, round(per_user, 6) as per_user_tok_s, round(system_tok_s, 6) as system_tok_s,
      round(total_tok_s, 6) as total_tok_s, round(rps, 6) as rps, round(rate_limited_rate, 6) as rate_limited_rate,
      rate_limited_rate > 0.01 as rate_limited_flagged, steady_samples >= greatest(min_samples, 1) as min_samples_met,
      ui as usage_incomplete_count, cv as cache_busting_violations, goodput_count,
      round(goodput_attainment, 6) as goodput_attainment, round(goodput_rps, 6) as goodput_rps,
      round(total_cost_usd, 9) as total_cost_usd, round(cost_per_1k_requests, 9) as cost_per_1k_requests,
      case when mode = 'open' then cast(3 as bigint) end as max_outstanding_events, wide.* exclude (run_id, level_or_rate)
    from (select *, {DERIVED} from levels) left join wide using (run_id, level_or_rate)"""


def _axis(source: str, column: str, numeric: bool) -> str:
    order = f"cast({column} as double)" if numeric else (
        f"case {column} when 'short' then 0 when 'medium' then 1 when 'long' then 2 else 99 end, {column}"
    )
    return (
        f"select run_id, x, {str(numeric).lower()} as numeric, cast(row_number() over (partition by run_id order by "
        f"{order.replace(column, 'x')}) as integer) as x_position "
        f"from (select distinct run_id, cast({column} as varchar) as x from {source})"
    )


def _panel(title: str, cells: str, series: str, value: str, chart: str = "line", position: str = "1") -> str:
    return (
        f"select run_id, '{title}' as panel, x, x_position, cast({position} as integer) as g_position, {series} as series, round({value}, 6) as value, "
        f"'{chart}' as chart from {cells}"
    )


def _dash() -> str:
    window = "nullif(greatest(max(t_start + e2e) - min(t_start), 0), 0)"
    cells = f""", axis as ({_axis('sss', 'level_or_rate', True)}),
    c as (select run_id, x, any_value(x_position) as x_position, quantile_cont(ttft, 0.5) * 1000 as ttft50,
            quantile_cont(ttft, 0.99) * 1000 as ttft99, quantile_cont(e2e, 0.5) * 1000 as e50, quantile_cont(e2e, 0.99) * 1000 as e99,
            sum(output_tokens) / {window} as tok, count(*) / {window} as rps, quantile_cont(prompt_tokens, 0.5) as it,
            quantile_cont(output_tokens, 0.5) as ot, avg(quality_score) as qm, quantile_cont(quality_score, 0.5) as q50
          from sss join axis on axis.run_id = sss.run_id and axis.x = cast(level_or_rate as varchar) group by sss.run_id, x),
    grid as (select a.run_id, a.x, a.x_position, b.x as g, b.x_position as gp from axis a join ({_axis('sss', 'osl_bucket', False)}) b on a.run_id = b.run_id),
    c2 as (select run_id, cast(level_or_rate as varchar) as x, osl_bucket as g, quantile_cont(e2e, 0.5) * 1000 as e50 from sss group by all),
    g2 as (select grid.run_id, x, x_position, g, gp, e50 from grid left join c2 using (run_id, x, g))"""
    cells = cells.replace("select run_id, x, any_value", "select sss.run_id, x, any_value")
    parts = [
        _panel("Latency vs load", "c", "'ttft p50 (ms)'", "ttft50"), _panel("Latency vs load", "c", "'ttft p99 (ms)'", "ttft99"),
        _panel("Latency vs load", "c", "'e2e p50 (ms)'", "e50"), _panel("Latency vs load", "c", "'e2e p99 (ms)'", "e99"),
        _panel("Throughput vs load", "c", "'system_tok_s (tok/s)'", "tok"), _panel("Throughput vs load", "c", "'rps (req/s)'", "rps"),
        _panel("E2E latency by output length", "g2", "'e2e p50 (ms) [' || g || ']'", "e50", position="gp"),
        _panel("Tokens per request vs load", "c", "'input_tokens p50'", "it"),
        _panel("Tokens per request vs load", "c", "'output_tokens p50'", "ot"),
        _panel("Quality score vs load", "c", "'quality_score mean'", "qm"),
        _panel("Quality score vs load", "c", "'quality_score p50'", "q50"),
    ]
    return cells + " " + " union all ".join(parts)


def _pivot() -> str:
    window = "nullif(greatest(max(t_start + e2e) - min(t_start), 0), 0)"
    return f""", axis as ({_axis('sss', 'isl_bucket', False)}),
    grid as (select a.run_id, a.x, a.x_position, b.x as g, b.x_position as gp from axis a join ({_axis('sss', 'category', False)}) b on a.run_id = b.run_id),
    c as (select run_id, isl_bucket as x, category as g, quantile_cont(e2e, 0.5) * 1000 as e50, count(*) / {window} as rps,
            count(quality_score) as n from sss group by all),
    f as (select grid.run_id, x, x_position, g, gp, e50, rps, coalesce(n, 0)::double as n from grid left join c using (run_id, x, g))
    """ + " union all ".join(
        _panel("E2E by length", "f", f"'{label} [' || g || ']'", value, "bar", "gp")
        for label, value in (("e2e p50 (ms)", "e50"), ("rps (req/s)", "rps"), ("quality_score count", "n"))
    )


def _sparse() -> str:
    window = "nullif(greatest(max(t_start + e2e) - min(t_start), 0), 0)"
    return f""", axis as ({_axis('sss', 'level_or_rate', True)}), marks as ({_axis('sss', 'prompt_id', False)}),
    c as (select run_id, cast(level_or_rate as varchar) as x, prompt_id as g, max(output_tokens) as tokens, count(*) / {window} as rps from sss group by all),
    f as (select c.run_id, c.x, a.x_position, c.g, m.x_position as gp, tokens, rps
      from c join axis a on a.run_id = c.run_id and a.x = c.x join marks m on m.run_id = c.run_id and m.x = c.g)
    """ + " union all ".join(
        _panel("Tokens by prompt", "f", f"'{label} [' || g || ']'", value, position="gp") for label, value in (("output_tokens max", "tokens"), ("rps (req/s)", "rps"))
    )


WINDOW_RATE = "round(rate_limited / greatest(steady_samples, 1), 6) as rate_limited_rate"


def _stream_levels(starts: str, size: str) -> str:
    return f""", w as (select *, {starts} as window_start from timed_steady),
    c as (select window_start, window_start + interval {size} as window_end, run_id, level_or_rate, count(*) as steady_samples,
            count(*) filter (outcome = 'success') as completed, count(*) filter (outcome <> 'success') as failed,
            count(*) filter (outcome = 'rate_limited') as rate_limited from w group by all)
    """


SPAN_STATS = """select 'llm.call' as name, o_orderpriority as model, count(*) as spans,
  round(avg(cast(o_custkey % 512 as double) / 1000), 6) as mean_duration_s, round(max(cast(o_custkey % 512 as double) / 1000), 6) as max_duration_s,
  cast(sum(o_custkey % 300) as bigint) as output_tokens from orders group by o_orderpriority"""

TOOL_CALLS = """, calls as (select distinct 'run-' || cast(l_suppkey % 5 as varchar) as run_id, 'tool-' || cast(l_suppkey % 7 as varchar) as tool,
  l_suppkey % 5 as a, l_linenumber % 3 as b, l_suppkey % 7 as r from lineitem) """

CANDIDATES = """, cand as (select 'candidate-' || cast(c_custkey as varchar) as run_id,
  case when c_nationkey % 2 = 0 then 'open' else 'closed' end as mode, cast(c_custkey % 60 as double) as duration_s,
  round(cast(c_custkey % 45 * 400 as double) * 0.001, 6) as warmup_s,
  case when c_custkey % 37 = 7 then null when c_custkey % 5 = 1 then 6.0 else 5.0 end::double as cooldown_s, c_custkey % 4 as first_level from customer) """

LINES = """, whole as (select *, l_suppkey % 11 as kind, l_linenumber * 1000 + l_partkey % 1000 as s from lineitem where l_suppkey % 11 <> 1),
  lines as (select w.* from whole w left join (select l_orderkey, min(s) as stop from whole where kind = 0 group by l_orderkey) e using (l_orderkey)
    where stop is null or s <= stop) """

ORACLES: dict[str, str] = {
    # sources
    "scan_raw": BASE + f"select {RECORD_CHECK} from records",
    "scan_rollup": BASE + f"select {RECORD_CHECK} from records",
    "scan_by_suffix": BASE
    + "select kind, outcome, count(*) as n, cast(sum(output_tokens) as bigint) as tokens "
    + "from records, (values ('parquet'), ('jsonl')) as k(kind) group by all",
    "scan_empty": BASE + "select count(*) as n, cast(sum(output_tokens) as bigint) as tokens from records where outcome = 'unknown'",
    "scan_runs": BASE + "select run_id as run, count(*) as requests, round(avg(e2e), 6) as mean_e2e from records "
    "where run_id <> 'run-3' group by run_id",
    "resolve_run": BASE + "select run_id as run, count(*) as requests from records where run_id in ('run-1', 'run-4') group by run_id",
    "newest_runs": BASE + "select distinct run_id as run from records order by run desc limit 2",
    "scan_prompts": BASE
    + "select id, library, category, isl_bucket, expected_output, 1 as messages, case when p_size % 9 = 0 then 1 else 0 end as tools, "
    "case when p_size % 9 = 0 then 1 else 0 end as tool_results from prompts",
    "scan_prompts_rejects": "select case when p_size % 17 = 16 then '' else 'prompt-' || cast(p_partkey as varchar) end as id, "
    "'library-' || cast(p_size % 3 as varchar) as library, case when p_size % 17 = 16 then 'missing id' else 'missing messages' end as reason "
    "from part where p_size % 17 = 16 or p_size % 19 = 18",
    "dim_models": "select s_suppkey as position, s_name as name, 'vendor-' || cast(s_nationkey as varchar) || '/' || s_name as model, "
    "s_suppkey % 2 = 0 as supports_tools, s_suppkey % 3 = 0 as supports_vision, "
    "round(case when s_suppkey % 4 <> 3 then s_acctbal / 1000 end, 6) as price_input, round(s_acctbal / 500, 6) as price_output, "
    "s_suppkey = (select min(s_suppkey) from supplier) as is_default from supplier",
    "dim_slo": """with p as (
      select case when c_custkey = 0 then 'relaxed' else 'profile-' || cast(c_custkey as varchar) end as name,
        case when c_custkey % 3 <> 0 then 100.0::double + c_custkey % 7 end as ttft_ms,
        case when c_custkey % 4 <> 0 then 10.0::double + c_custkey % 5 end as tpot_ms, cast(null as double) as e2e_ms from customer
      union all select 'interactive', 500, 50, 5000)
      select name, case when name = 'profile-5' then 300 else ttft_ms end as ttft_ms, tpot_ms,
        case when name = 'relaxed' then 9000 else e2e_ms end as e2e_ms from p
      union all select 'fresh', null, 7, null""",
    "scan_chunks": "with x as (select 1) " + LINES
    + """select cast(l_orderkey as varchar) as request_id, s as seq, round(cast(s as double) / 4099, 6) as arrival_s,
      case when kind not in (0, 2, 3) then l_returnflag end as content, kind = 0 as done, kind <> 2 as parse_ok,
      case when kind = 3 then l_partkey end as prompt_tokens, case when kind = 3 then cast(l_quantity as bigint) end as completion_tokens,
      case when kind = 3 then cast(3 as bigint) end as cached_tokens from lines""",
    "adhoc_json": """select 'lines' as form, count(*) as n, cast(sum(c_custkey) as bigint) as total, count(distinct c_mktsegment) as kinds,
        count(*) filter (c_custkey % 7 = 0) as odd, cast(coalesce(sum(c_custkey % 100) filter (c_custkey % 7 <> 0), 0) as double) as v from customer
      union all select 'array', count(*), cast(sum(n_nationkey) as bigint), count(distinct n_name), 0, cast(sum(n_regionkey) as double) from nation
      union all select 'documents', count(*), cast(sum(r_regionkey) as bigint), 5, 0,
        cast(sum(case when r_regionkey = 1 then 100000 else 30 end) as double) from region""",
    "line_records": "with x as (select 1) " + LINES
    + """, texts as (select cast(l_orderkey as varchar) as request_id, cast(s as double) / 4099 as t from lines where kind not in (0, 2, 3)),
      gaps as (select request_id, t - lag(t) over w as gap, row_number() over w as rn from texts window w as (partition by request_id order by t)),
      itl as (select request_id, max(case when rn = 2 then gap end) as tt2t, quantile_cont(gap, 0.95) as p95 from gaps where gap is not null group by request_id),
      f as (select cast(l_orderkey as varchar) as request_id, min(case when kind not in (0, 2, 3) then cast(s as double) / 4099 end) as ttft,
          count(*) filter (kind not in (0, 2, 3)) as deltas, count(*) filter (kind = 3) as usages, bool_or(kind = 0) as done, bool_and(kind <> 2) as clean,
          arg_max(l_partkey, s) filter (kind = 3) as prompt, arg_max(cast(l_quantity as bigint), s) filter (kind = 3) as completion
        from lines group by l_orderkey),
      o as (select cast(o_orderkey as varchar) as request_id, 2.0::double + cast(o_custkey % 512 as double) / 257 as e2e,
          case when o_orderkey % 97 = 0 then 429 when o_orderkey % 101 = 0 then 503 else 200 end as status,
          case when o_orderkey % 53 = 0 then 'timeout' when o_orderkey % 59 = 0 then 'protocol' when o_orderkey % 61 = 0 then 'connection' end as kind from orders),
      j as (select o.*, f.* exclude (request_id), tt2t, p95, case when kind = 'timeout' then 'timeout' when kind = 'protocol' then 'malformed_stream'
          when kind is not null then 'connection_error' when status = 429 then 'rate_limited' when status <> 200 then 'connection_error'
          when coalesce(done, false) and coalesce(clean, true) then 'success' else 'malformed_stream' end as outcome
        from o left join f using (request_id) left join itl using (request_id))
      select request_id, outcome, case when kind is null then status else 0 end as status_code, round(e2e, 6) as e2e, outcome = 'success' and usages = 0 as usage_incomplete,
        round(case when outcome = 'success' then ttft end, 6) as ttft, round(case when outcome = 'success' then tt2t end, 6) as tt2t,
        round(case when outcome = 'success' then p95 end, 6) as itl_p95,
        case when outcome <> 'success' then 0 else coalesce(prompt, 0) end as prompt_tokens,
        case when outcome <> 'success' then 0 when usages = 0 then deltas else completion end as output_tokens,
        case when outcome = 'success' and usages > 0 then 3 else 0 end as cached_tokens,
        case when outcome = 'success' then null when kind is not null then kind when outcome = 'malformed_stream' then 'malformed stream'
          else 'HTTP ' || cast(status as varchar) end as error from j""",
    "scan_chunk_table": BASE
    + "select request_id, round(min(arrival_s), 6) as ttft from (select request_id, case when content <> '' then arrival_s end as arrival_s "
    "from chunks union all select request_id, null from finals) group by request_id",
    "scan_spans": """select 'llm.call' as name, md5(cast(o_custkey as varchar)) as trace_id, md5(cast(o_orderkey as varchar)) as span_id,
      cast(epoch(o_orderdate) as bigint) * 1000000000 as start_time,
      cast(epoch(o_orderdate) as bigint) * 1000000000 + (o_custkey % 512) * 1000000 as end_time,
      round(cast(o_custkey % 512 as double) / 1000, 6) as duration_s,
      case when o_orderkey % 97 = 0 then 'rate_limited' else 'success' end as outcome from orders""",
    "span_stats": SPAN_STATS,
    # sinks
    "sink_raw": BASE + "select run_id, count(*) as lines from records group by run_id",
    "drop_content": BASE
    + "select request_id, 'cached_tokens,category,cost_usd,e2e,error,isl_bucket,itl_summary,level_or_rate,mode,model,"
    "normalized_latency,osl_bucket,outcome,output_tokens,phase,prompt_id,prompt_tokens,reasoning_tokens,request_id,retry_count,run_id,seed,"
    "status_code,t_start,tpot,tt2t,ttft,usage_incomplete' as persisted from records",
    "flatten_rollup": BASE + f"select {RECORD_CHECK} from records",
    "sink_summary": BASE
    + "select l.run_id, l.level_or_rate, completed, round(p99, 6) as e2e_p99 from levels l left join stats_of s "
    "on s.run_id = l.run_id and s.level_or_rate = l.level_or_rate and metric = 'e2e'",
    "sink_tool_calls": "with x as (select 1) " + TOOL_CALLS + "select run_id, count(*) as calls from calls group by run_id",
    "dedup_tool_calls": """select 'run-' || cast(l_suppkey % 5 as varchar) as run_id, 'tool-' || cast(l_suppkey % 7 as varchar) as tool,
      '{"a":' || cast(l_suppkey % 5 as varchar) || ',"b":' || cast(l_linenumber % 3 as varchar) || '}' as arguments,
      '{"r":' || cast(l_suppkey % 7 as varchar) || '}' as result, min(l_orderkey * 100 + l_linenumber) as first_seq
      from lineitem group by all""",
    "sink_spans": SPAN_STATS,
    # per-request derivation
    "ttft": BASE + "select request_id, round(ttft, 6) as ttft from facts",
    "tt2t": BASE + "select request_id, round(tt2t, 6) as tt2t from itl",
    "itl_gaps": BASE
    + """select request_id, round(since, 6) as since, round(gap, 6) as gap, count(*) as n from gaps where gap is not null group by
      request_id, gaps.since, gaps.gap""",
    "itl_summary": BASE + "select t.request_id, " + _r("tt2t", "itl_mean", "itl_p50", "itl_p95", "itl_p99", "itl_max")
    + " from (select distinct request_id from texts) t left join itl using (request_id)",
    "itl_list": BASE
    + "select request_id, cast(count(*) as integer) as gaps, round(arg_min(gap, rn), 6) as first_gap, round(arg_max(gap, rn), 6) as last_gap "
    "from gaps where gap is not null group by request_id",
    "tpot": BASE + "select request_id, round(tpot, 6) as tpot from records",
    "norm_latency": BASE + "select request_id, round(normalized_latency, 6) as normalized_latency from records",
    "cost_usd": BASE + "select request_id, model, round(cost_usd, 9) as cost_usd from records",
    "isl_bucket": BASE + "select request_id, prompt_tokens, isl_bucket from records",
    "osl_bucket": BASE + "select request_id, output_tokens, osl_bucket from records",
    "usage_fold": BASE
    + "select request_id, coalesce(l_prompt, 0) as prompt_tokens, case when usages = 0 then deltas else coalesce(l_completion, 0) end "
    "as output_tokens, coalesce(l_cached, 0) as cached_tokens, coalesce(l_reasoning, 0) as reasoning_tokens, usages = 0 as usage_incomplete from facts",
    "classify_outcome": BASE + "select request_id, outcome, status_code, round(e2e, 6) as e2e from outcomes",
    "phase_tag": BASE + "select request_id, run_id, round(t_start, 6) as t_start, phase from records",
    "steady_end": "with x as (select 1) " + CANDIDATES
    + "select run_id, duration_s, warmup_s, cooldown_s, round(case when duration_s - cooldown_s <= warmup_s then duration_s "
    "else duration_s - cooldown_s end, 6) as steady_end_s from cand",
    "validate_runs": "with x as (select 1) " + CANDIDATES
    + """select run_id, 'rate must be positive' as rule from cand where mode = 'open' and first_level <= 0
      union all select run_id, 'level must be at least 1' from cand where mode = 'closed' and first_level < 1
      union all select run_id, 'unreadable duration' from cand where cooldown_s is null
      union all select run_id, 'warmup and cooldown exceed the duration' from cand where warmup_s + cooldown_s > duration_s""",
    "duration_s": """with t as (select o_orderkey, o_orderkey % 6 as f, o_custkey % 600 as n, cast(o_custkey % 600 as varchar) as s from orders)
      select o_orderkey, case f when 0 then s || 'ms' when 1 then ' ' || s || '.5 s ' when 2 then s || 'm' when 3 then s || 'h'
        when 4 then s else s || ' days' end as text,
      round(case f when 0 then n * 0.001::double when 1 then n + 0.5::double when 2 then n * 60 when 3 then n * 3600 when 4 then n end, 6) as seconds from t""",
    "unit_scale": BASE
    + """select request_id, 'ttft' as metric, round(ttft * 1000, 6) as shown from records
      union all select request_id, 'e2e', round(e2e * 1000, 6) from records
      union all select request_id, 'input_tokens', prompt_tokens from records
      union all select request_id, 'output_tokens', output_tokens from records""",
    "cache_violation": BASE + "select request_id, cached_tokens, cache_violation from records",
    "cache_bust_prefix": BASE
    + "select conv_id, turn, role, case when role = 'user' and turn = last_turn then '[cb-' || md5(cast(conv_id as varchar) || ':7') || '] ' "
    "|| text else text end as text from turns",
    "cache_bust_messages": BASE
    + "select id, case when p_size % 4 <> 0 then '[cb-' || md5(id || ':7') || '] ' || p_name end as content from prompts",
    "prompt_caps": BASE
    + "select id, p_size % 9 = 0 or category = 'tool-use' as requires_tools, category = 'vision' or p_size % 8 = 0 as requires_vision from prompts",
    "tool_call_merge": BASE + """, p as (select cast(l_orderkey as varchar) as request_id, cast(l_linenumber % 2 as integer) as index,
      ((l_linenumber * 1000 + l_partkey % 1000) * 1000000 + l_suppkey) * 100 + cast(l_quantity as bigint) as seq,
      case when l_quantity > 25 then 'tool-' || cast(l_suppkey % 7 as varchar) end as name, '<' || cast(l_partkey as varchar) || '>' as arg
      from lineitem where l_tax = 0 and not (l_linenumber % 5 = 4 and l_partkey % 4 = 0))
      select request_id, index, coalesce(arg_max(name, seq) filter (name is not null), '') as name,
      string_agg(arg, '' order by seq) as arguments from p left join stopped using (request_id) where stop is null or seq < stop group by all""",
    "tool_args_parse": """select l_orderkey * 100 + l_linenumber as seq, 'tool-' || cast(l_suppkey % 7 as varchar) as tool,
      case when (l_orderkey * 100 + l_linenumber) % 3 = 0 then '{"a":' || cast(l_suppkey % 5 as varchar) || ',"b":' ||
      cast(l_linenumber % 3 as varchar) || '}' else '{}' end as arguments from lineitem""",
    "output_text": BASE + "select request_id, string_agg(content, '' order by seq) as output_text from texts group by request_id",
    "slug": "select page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'run') as slug from pages",
    "self_preference": "select s_name as name, 'vendor-' || cast(s_nationkey as varchar) as family, s_suppkey % 25 = s_nationkey as same_family from supplier",
    "summary_row": BASE
    + """select l.run_id, cast(l.level_or_rate as varchar) as level, cast(steady_samples as varchar) as samples,
      coalesce(printf('%.1fms', e.p50 * 1000), '-') as e2e_p50, coalesce(printf('%.1fms', e.p99 * 1000), '-') as e2e_p99,
      coalesce(printf('%.1fms', t.p50 * 1000), '-') as ttft_p50, coalesce(printf('%.1fms', t.p99 * 1000), '-') as ttft_p99,
      printf('%.1f', case when steady_samples > 0 then completed / steady_samples * 100 else 0.0::double end) as success_pct,
      printf('%.1f', rate_limited / greatest(steady_samples, 1) * 100) as rate_limited_pct
      from levels l left join stats_of e on e.run_id = l.run_id and e.level_or_rate = l.level_or_rate and e.metric = 'e2e'
      left join stats_of t on t.run_id = l.run_id and t.level_or_rate = l.level_or_rate and t.metric = 'ttft'""",
    "record_build": BASE
    + "select run_id, model, mode, level_or_rate, phase, cast(42 as bigint) as seed, request_id, prompt_id, category, "
    + _r("t_start", "ttft", "tt2t", "e2e", "tpot", "normalized_latency")
    + ", output_tokens, prompt_tokens, cached_tokens, reasoning_tokens, usage_incomplete, isl_bucket, osl_bucket, round(cost_usd, 9) as cost_usd, "
    "outcome, status_code, 0 as retry_count, error, cache_violation, "
    + _r("itl_mean", "itl_p50", "itl_p95", "itl_p99", "itl_max")
    + " from records",
    # filters
    "steady_success": BASE + "select request_id, run_id, level_or_rate from ss",
    "meets_slo": BASE + "select request_id, meets_slo from slo_rows",
    "eval_eligible": BASE + "select request_id, phase from scored where eligible",
    "numeric_only": "select cast(o_orderkey as varchar) as request_id, case o_orderkey % 4 when 0 then o_custkey + 0.5::double "
    "when 2 then o_custkey end as ttft from orders",
    "failures_excluded": BASE
    + "select run_id, count(*) as samples, round(max(e2e), 6) as max_e2e, cast(sum(output_tokens) as bigint) as tokens from ss group by run_id",
    # joins
    "eval_backfill": BASE
    + "select request_id, eval_status, round(sim_score, 6) as sim_score, round(quality_score, 6) as quality_score, quality_pass, judge_verdict, "
    "judge_reason from scored",
    "eval_status": BASE + "select run_id, eval_status, count(*) as requests from scored group by all",
    "prompt_enrich": BASE
    + "select request_id, prompt_id, p.category, p.expected_output from requests r left join prompts p on p.id = r.prompt_id",
    "price_enrich": BASE + "select request_id, mode, model, price_input, price_output from requests join runs using (run_id)",
    "slo_enrich": BASE + "select request_id, ttft_ms, tpot_ms, e2e_ms from slo_rows",
    "capability_gate": BASE
    + """select run_id, model, id as prompt_id, case when (p_size % 9 = 0 or category = 'tool-use') and not supports_tools then 'tools_unsupported'
      when (category = 'vision' or p_size % 8 = 0) and not supports_vision then 'vision_unsupported' end as skip_reason
      from prompts join runs using (library)""",
    "skip_counts": BASE
    + """select run_id, count(*) filter (t and not supports_tools) as tools_unsupported,
      count(*) filter (v and not supports_vision and not (t and not supports_tools)) as vision_unsupported
      from (select *, p_size % 9 = 0 or category = 'tool-use' as t, category = 'vision' or p_size % 8 = 0 as v from prompts)
      join runs using (library) group by run_id""",
    "tool_result_lookup": BASE
    + """select 'prompt-' || cast(l_partkey as varchar) as prompt_id, 'tool-' || cast(l_suppkey % 7 as varchar) as name,
      case when p.p_size % 9 = 0 and p.p_partkey % 7 = l_suppkey % 7 then '{"r": ' || cast(p.p_partkey as varchar) || '}' end as result,
      count(*) as calls from lineitem left join prompts p on p.p_partkey = l_partkey group by all""",
    "levels_left": BASE + "select run_id, level_or_rate, steady_samples from levels",
    "pair_cosine": "select a.vec_id // 2 as pair_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim_score "
    "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0",
    "level_overlap": BASE
    + """, spans as (select run_id, level_or_rate, min(t_start) as span_start, max(t_start + e2e) as span_end from records group by all),
      e as (select *, max(span_end) over (partition by run_id order by span_start, level_or_rate rows between unbounded preceding and 1 preceding)
        as earlier_end from spans)
      select run_id, level_or_rate, round(span_start, 6) as span_start, round(span_end, 6) as span_end, round(earlier_end, 6) as earlier_end
      from e where span_start < earlier_end""",
    "replay_prefix": BASE
    + """, p as (select run_id, prompt_id, row_number() over (partition by run_id order by t_start, request_id) as position from requests),
      j as (select a.run_id, a.position, a.prompt_id <> b.prompt_id as differs from p a join p b on b.position = a.position and b.run_id = 'run-0'
        where a.run_id <> 'run-0')
      select run_id, count(*) as compared, min(position) filter (differs) as first_mismatch,
        coalesce(min(position) filter (differs) - 1, count(*)) as common_prefix from j group by run_id""",
    # aggregates
    "pct_object": BASE + "select run_id, level_or_rate, metric, samples, " + _r(*STATS) + " from stats_of where metric <> 'itl'",
    "itl_pool": BASE + "select run_id, level_or_rate, metric, samples, " + _r(*STATS) + " from stats_of where metric = 'itl'",
    "steady_window": BASE
    + "select run_id, level_or_rate, round(coalesce(w, 0), 6) as steady_window_s from rel left join thr using (run_id, level_or_rate)",
    "throughput": BASE
    + """select run_id, level_or_rate, rel.completed, round(case when w > 0 then so / w else 0 end, 6) as system_tok_s,
      round(case when w > 0 then st / w else 0 end, 6) as total_tok_s, round(case when w > 0 then rel.completed / w else 0 end, 6) as rps
      from rel left join thr using (run_id, level_or_rate)""",
    "per_user_tok_s": BASE
    + "select run_id, level_or_rate, round(coalesce(per_user, 0), 6) as per_user_tok_s from rel left join thr using (run_id, level_or_rate)",
    "goodput": BASE
    + """select run_id, level_or_rate, coalesce(goodput_count, 0) as goodput_count,
      round(case when rel.completed > 0 then coalesce(goodput_count, 0) / rel.completed else 0 end, 6) as goodput_attainment,
      round(case when w > 0 then coalesce(goodput_count, 0) / w else 0 end, 6) as goodput_rps
      from rel left join thr using (run_id, level_or_rate) left join good using (run_id, level_or_rate)""",
    "level_cost": BASE
    + """select run_id, level_or_rate, rel.completed, round(case when priced then coalesce(cost, 0) end, 9) as total_cost_usd,
      round(case when priced then case when rel.completed > 0 then cost / rel.completed * 1000 else 0 end end, 9) as cost_per_1k_requests
      from rel left join thr using (run_id, level_or_rate)
      left join (select run_id, level_or_rate, count(cost_usd) > 0 as priced from records group by all) using (run_id, level_or_rate)""",
    "run_cost": BASE
    + """select run_id, round(sum(case when priced then cost end), 9) as total_cost_usd, cast(sum(completed) as bigint) as completed,
      round(case when bool_or(priced) then sum(cost) / sum(completed) * 1000 end, 9) as cost_per_1k_requests from levels group by run_id""",
    "reliability": BASE
    + "select *, round(rate_limited / greatest(steady_samples, 1), 6) as rate_limited_rate, "
    "rate_limited / greatest(steady_samples, 1) > 0.01 as rate_limited_flagged from rel",
    "level_summary": BASE + _level_summary(),
    "run_summary": BASE
    + """select u.run_id, u.mode, u.model, count(request_id) as requests, count(*) filter (usage_incomplete) as usage_incomplete_count,
      count(*) filter (cache_violation) as cache_busting_violations from runs u left join records r on r.run_id = u.run_id group by all""",
    "counters": BASE
    + """select run_id, level_or_rate, count(*) filter (s and usage_incomplete) as usage_incomplete_count,
      count(*) filter (s and cache_violation) as cache_busting_violations, count(*) filter (usage_incomplete) as usage_incomplete_all_phases,
      count(*) filter (cache_violation) as cache_violations_all_phases
      from (select *, phase = 'steady' and outcome = 'success' as s from records) group by all""",
    "eval_coverage": BASE
    + """select run_id, count(*) filter (eval_status = 'judged') as judged, count(*) filter (eval_status <> 'skipped_no_expected') as total_eligible,
      count(*) filter (eval_status = 'eval_dropped') as dropped,
      round(count(*) filter (eval_status = 'judged') / count(*) filter (eval_status <> 'skipped_no_expected'), 6) as coverage
      from scored group by run_id""",
    "cosine": "select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) as to_reverse, "
    "0.0::double as to_zero from embeddings",
    "panel_agg": BASE
    + """select run_id, category, round(quantile_cont(e2e, 0.5) * 1000, 6) as e2e_p50, round(quantile_cont(e2e, 0.9) * 1000, 6) as e2e_p90,
      round(quantile_cont(e2e, 0.95) * 1000, 6) as e2e_p95, round(quantile_cont(e2e, 0.99) * 1000, 6) as e2e_p99, round(avg(e2e) * 1000, 6) as e2e_mean,
      round(max(e2e) * 1000, 6) as e2e_max, round(min(e2e) * 1000, 6) as e2e_min, count(e2e)::double as e2e_count from sss group by all""",
    "panel_rate": BASE
    + """select run_id, category, osl_bucket, round(count(*) / nullif(max(t_start + e2e) - min(t_start), 0), 6) as rps_p50,
      round(sum(output_tokens) / nullif(max(t_start + e2e) - min(t_start), 0), 6) as system_tok_s_p50 from sss group by all""",
    "tool_call_counts": "with x as (select 1) " + TOOL_CALLS + "select run_id, tool, count(*) as invocations from calls group by all",
    # panels
    "panel_pivot": BASE + _pivot(),
    "panel_dense": BASE
    + """, grid as (select run_id, x, g from (select distinct run_id, prompt_id as x from sss) join (select distinct run_id, osl_bucket as g from sss)
        using (run_id)), c as (select run_id, prompt_id as x, osl_bucket as g, count(cost_usd) as n from sss group by all)
      select run_id, x, g, coalesce(n, 0)::double as cost_usd_count from grid left join c using (run_id, x, g)""",
    "axis_order": BASE
    + "select 'level_or_rate' as dimension, * from (" + _axis("ss", "level_or_rate", True) + ") union all select 'isl_bucket', * from ("
    + _axis("ss", "isl_bucket", False) + ") union all select 'category', * from (" + _axis("ss", "category", False) + ") union all select 'prompt_id', * from (" + _axis("ss", "prompt_id", False) + ")",
    "panel_sparse": BASE + _sparse(),
    "dash_from_file": BASE + _dash(),
    "panel_definitions": """with d as (select cast(c_custkey as integer) as position,
        case when c_custkey % 3 = 0 then 'Panel ' || c_custkey else c_name end as title,
        coalesce(case c_nationkey % 4 when 0 then 'model' when 1 then 'level_or_rate' when 2 then 'nothing' end, '') as x,
        case c_custkey % 5 when 0 then 'isl_bucket' when 2 then 'other' end as "group",
        coalesce(case c_custkey % 7 when 0 then 'line' when 1 then 'pie' end, 'auto') as chart,
        case when c_custkey % 11 <> 0 then case when c_custkey % 13 = 0 then 'speed' else 'ttft' end end as metric,
        case when c_custkey % 11 <> 0 then coalesce(case c_custkey % 17 when 0 then 'median' when 1 then 'p99' end, 'p50') end as agg from customer)
      select position, title, x, "group", chart, agg, case when x not in ('model', 'level_or_rate') then 'x is no dimension'
        when "group" = 'other' then 'group is no dimension' when chart = 'pie' then 'chart must be line, bar or auto'
        when metric is null then 'at least one value is needed' when metric = 'speed' then 'unknown metric' when agg = 'median' then 'unknown aggregate' end as reason
      from d""",
    "distinct_axis": BASE + "select distinct run_id, prompt_id as x from ss",
    "series_name": BASE + "select distinct run_id, 'ttft p99 (ms) [' || cast(level_or_rate as varchar) || ']' as series from ss",
    "chart_kind": BASE + "select distinct run_id, dimension, chart from ss, (values ('level_or_rate', 'line'), ('isl_bucket', 'bar')) as d(dimension, chart)",
    "dash_default": BASE + _dash(),
    # windows
    "arrival_gaps": BASE
    + """, g as (select run_id, level_or_rate, t_start - lag(t_start) over (partition by run_id, level_or_rate order by t_start) as gap from requests)
      select g.run_id, level_or_rate, count(gap) as gaps, round(avg(gap), 6) as mean_gap, round(stddev_pop(gap) / avg(gap), 6) as cv,
        round(case when any_value(mode) = 'open' then 1 / level_or_rate end, 6) as target_mean
      from g join runs using (run_id) group by g.run_id, level_or_rate""",
    "in_flight": BASE
    + """, ev as (select run_id, level_or_rate, t_start as t, 1 as d from records union all select run_id, level_or_rate, t_start + e2e, -1 from records),
      net as (select run_id, level_or_rate, t, sum(d) as d from ev group by all)
      select run_id, level_or_rate, round(t, 6) as t, cast(sum(d) over (partition by run_id, level_or_rate order by t) as bigint) as in_flight from net""",
    "load_peaks": BASE
    + """, ev as (select run_id, level_or_rate, t_start as t, 1 as d from records union all select run_id, level_or_rate, t_start + e2e, -1 from records),
      run_sum as (select *, sum(d) over w as now, lead(t) over w - t as held from ev
        window w as (partition by run_id, level_or_rate order by t, d rows between unbounded preceding and current row))
      select run_id, level_or_rate, cast(max(now) as bigint) as peak, round(coalesce(sum(held) filter (now >= 50), 0), 6) as seconds_at_cap
      from run_sum group by all""",
    "seq_position": BASE
    + "select run_id, request_id, row_number() over (partition by run_id order by t_start, request_id) as position from requests",
    "chunk_order": BASE
    + """, o as (select request_id, arrival_s, row_number() over (partition by request_id order by arrival_s) as rn,
        count(*) over (partition by request_id) as tokens from texts)
      select request_id, round(arrival_s, 6) as arrival_s, min(rn) as first_position, max(rn) as last_position, any_value(tokens) as tokens
      from o group by request_id, o.arrival_s""",
    "union_modes": BASE
    + "select run_id, level_or_rate, mode, completed, case when mode = 'open' then cast(3 as bigint) end as max_outstanding_events from levels",
    # quality
    "embed_score": """select a.vec_id // 2 as pair_id, round(s, 6) as sim_score, round(s, 6) as quality_score, s >= 0.2 as quality_pass,
      'judged' as eval_status from (select a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s
      from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0) a""",
    "reply_content": BASE
    + """select request_id, case form when 0 then '{"score": 0.' || k || ', "reason": " ' || event_type || ' "}'
      when 1 then '{"score": 1.5, "reason": "high"}' when 2 then '{"score": -1}' when 3 then '{"score": "x", "reason": "word"}'
      when 4 then '{"score": null}' when 5 then ' 0.' || k || ' '
      when 6 then '{"verdict": " ' || case when user_id % 2 = 0 then 'PASS' else 'partial' end || ' ", "reason": "' || event_type || '"}'
      when 7 then '{"verdict": "Correct"}' when 8 then ' yes ' when 9 then 'no idea about ' || event_type when 10 then '{"score": "0.25"}'
      else '' end as content from replies""",
    "judge_score": BASE + "select request_id, round(score, 6) as score, score_reason as reason from verdicts",
    "judge_verdict": BASE + "select request_id, verdict, verdict_reason as reason from verdicts",
    "verdict_norm": BASE + "select request_id, rubric, norm as verdict from normal",
    "verdict_score": """with v as (select doc_id, case when quality = 1 then 'pass' when toxic = 1 then 'incorrect' when doc_id % 3 = 0 then 'partial'
      else 'unsure' end as verdict from labels)
      select doc_id, verdict, case verdict when 'pass' then 1.0::double when 'partial' then 0.5 else 0.0 end as score from v""",
    "score_replies": BASE
    + """select request_id, 'judged' as eval_status, round(case when rubric = 'score' then score else
      case norm when 'pass' then 1.0 when 'correct' then 1.0 when 'partial' then 0.5 else 0.0 end end, 6) as quality_score,
      case when rubric <> 'score' then norm end as judge_verdict,
      case when rubric = 'score' then score_reason else verdict_reason end as judge_reason from normal""",
    "text_counts": "select doc_id, length(text)::double as chars, (length(text) - length(replace(text, ' ', '')))::double as spaces, "
    "(length(text) - length(replace(text, 'e', '')))::double as letters_e from documents",
    # SQL
    "adhoc_sql": BASE
    + "select outcome, count(*) as n, cast(sum(output_tokens) as bigint) as tokens, round(avg(e2e), 6) as mean_e2e from records group by outcome",
    "adhoc_p99": BASE + "select run_id, level_or_rate, round(quantile_cont(ttft, 0.99), 6) as p99 from ss group by all",
    "adhoc_self_join": BASE
    + "select a.run_id, count(*) as pairs from records a join records b on a.prompt_id = b.prompt_id and a.run_id = b.run_id "
    "and a.level_or_rate = 1 and b.level_or_rate = 4 group by a.run_id",
    "adhoc_rollup": BASE + "select run_id, phase, count(*) as n from records group by rollup(run_id, phase)",
    "adhoc_cube": BASE + "select mode, outcome, count(*) as n from records group by cube(mode, outcome)",
    "adhoc_grouping_sets": BASE
    + "select run_id, outcome, cast(sum(output_tokens) as bigint) as tokens from records group by grouping sets ((run_id), (outcome), ())",
    "adhoc_rank": BASE
    + "select run_id, category, tokens, cast(rank() over (partition by run_id order by tokens desc) as integer) as place from "
    "(select run_id, category, cast(sum(output_tokens) as bigint) as tokens from records group by all)",
    "adhoc_union": BASE
    + "select prompt_id from records where run_id = 'run-1' and outcome <> 'success' union "
    "select prompt_id from records where run_id = 'run-2' and outcome <> 'success'",
    "adhoc_intersect": BASE
    + "select prompt_id from records where run_id = 'run-0' and outcome = 'success' intersect "
    "select prompt_id from records where run_id = 'run-0' and outcome <> 'success'",
    "adhoc_except": BASE
    + "select prompt_id from records where outcome = 'success' except select prompt_id from records where outcome <> 'success'",
    "adhoc_tool_log": """select tool, count(*) as calls, count(distinct arguments) as kinds, min(first_seq) as first_seq from (
        select 'run-' || cast(l_suppkey % 5 as varchar) as run_id, 'tool-' || cast(l_suppkey % 7 as varchar) as tool,
          '{"a":' || cast(l_suppkey % 5 as varchar) || ',"b":' || cast(l_linenumber % 3 as varchar) || '}' as arguments,
          '{"r":' || cast(l_suppkey % 7 as varchar) || '}' as result, min(l_orderkey * 100 + l_linenumber) as first_seq
        from lineitem group by all) group by tool""",
    "adhoc_distinct": BASE + "select distinct run_id, model, category from records",
    # report series
    "sys_tput_vs_level": BASE + "select run_id, level_or_rate, round(case when w > 0 then so / w else 0 end, 6) as system_tok_s from levels",
    "ttft_vs_level": BASE
    + "select run_id, level_or_rate, round(p50, 6) as ttft_p50, round(p95, 6) as ttft_p95, round(p99, 6) as ttft_p99 from stats_of where metric = 'ttft'",
    "user_tok_vs_level": BASE + "select run_id, level_or_rate, round(per_user, 6) as per_user_tok_s from levels",
    "ttft_vs_tput": BASE
    + "select s.run_id, s.level_or_rate, round(p50, 6) as ttft_p50, round(p95, 6) as ttft_p95, round(p99, 6) as ttft_p99, "
    "round(case when w > 0 then so / w else 0 end, 6) as system_tok_s from stats_of s join thr using (run_id, level_or_rate) where metric = 'ttft'",
    "ttft_cdf": BASE
    + """, c as (select run_id, level_or_rate, ttft, cume_dist() over (partition by run_id, level_or_rate order by ttft) as cdf from ss
        where ttft is not null)
      select distinct run_id, level_or_rate, round(ttft, 6) as ttft, round(cdf, 6) as cdf from c""",
    "ttft_cdf_grid": BASE
    + ", g as (select run_id, level_or_rate, unnest([i / 10 for i in range(11)]) as cdf, "
    "unnest(quantile_cont(ttft, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as ttft from ss group by run_id, level_or_rate) "
    "select run_id, level_or_rate, round(cdf, 6) as cdf, round(ttft, 6) as ttft from g",
    "outcome_share": BASE
    + """, o(outcome) as (values ('success'), ('rate_limited'), ('timeout'), ('malformed_stream'), ('connection_error')),
      n as (select run_id, level_or_rate, count(*) as total from records where phase = 'steady' group by all),
      c as (select run_id, level_or_rate, outcome, count(*) as k from records where phase = 'steady' group by all)
      select n.run_id, n.level_or_rate, o.outcome, coalesce(k, 0) as requests, round(coalesce(k, 0) / total, 6) as share
      from n join o on true left join c on c.run_id = n.run_id and c.level_or_rate = n.level_or_rate and c.outcome = o.outcome""",
    "compare_models": BASE
    + f""", d as (select l.*, {DERIVED}, t.p50 as ttft_p50, e.p99 as e2e_p99 from levels l
        left join stats_of t on t.run_id = l.run_id and t.level_or_rate = l.level_or_rate and t.metric = 'ttft'
        left join stats_of e on e.run_id = l.run_id and e.level_or_rate = l.level_or_rate and e.metric = 'e2e')
      select d.run_id, d.level_or_rate, d.model, """
    + ", ".join(f"round(d.{m}, 6) as {m}, round(d.{m} - b.{m}, 6) + 0.0 as delta_{m}" for m in ("rps", "system_tok_s", "ttft_p50", "e2e_p99", "goodput_attainment"))
    + " from d left join d b on b.run_id = 'run-0' and b.level_or_rate = d.level_or_rate",
    # streams: what the watermark has closed after the whole input
    "stream_assemble": BASE
    + "select request_id, outcome, status_code, error, prompt_tokens, output_tokens, cached_tokens, reasoning_tokens, usage_incomplete, "
    + _r("ttft", "tt2t", "e2e", "tpot", "normalized_latency", "itl_mean", "itl_p50", "itl_p95", "itl_p99", "itl_max")
    + ", cast(0 as bigint) as disordered from records",
    "stream_backfill": BASE
    + """, res as (select cast(event_id as varchar) as request_id, timestamp '2024-01-01 00:00:00' + to_seconds(event_id + (user_id % 10) * 60) as scored_at,
          case when event_type <> 'error' then 'judged' else 'eval_skipped' end as status,
          case when event_type <> 'error' then cast(json_extract_string(props, '$.k') as double) / 100 end as quality_score from events),
      j as (select t.*, status, quality_score from timed t left join res r on r.request_id = t.request_id and scored_at >= ts and scored_at <= ts + interval 5 minutes)
      select request_id, ts, case when not eligible then 'skipped_no_expected' when status is not null then status else 'eval_skipped' end as eval_status,
        round(case when eligible then quality_score end, 6) as quality_score
      from j""",
    "stream_levels": BASE
    + _stream_levels("time_bucket(interval 10 minutes, ts)", "10 minutes")
    + f"select *, {WINDOW_RATE}, rate_limited / greatest(steady_samples, 1) > 0.01 as rate_limited_flagged from c "
    "",
    "stream_levels_sliding": BASE
    + _stream_levels("unnest([time_bucket(interval 10 minutes, ts), time_bucket(interval 10 minutes, ts) - interval 10 minutes])", "20 minutes")
    + f"select *, {WINDOW_RATE}, rate_limited / greatest(steady_samples, 1) > 0.01 as rate_limited_flagged from c "
    "",
    "stream_level_percentiles": BASE
    + """select time_bucket(interval 30 minutes, ts) as window_start, run_id, level_or_rate, count(*) as samples,
      round(quantile_cont(e2e, 0.5), 6) as e2e_p50, round(quantile_cont(e2e, 0.99), 6) as e2e_p99 from timed_steady
      where outcome = 'success' group by all""",
    "stream_progress": BASE
    + """, e as (select run_id, count(*) as enqueued from timed where eligible group by run_id),
      s as (select 'run-' || cast(user_id % 5 as varchar) as run_id, count(*) as scored from events group by all)
      select run_id, coalesce(enqueued, 0) as enqueued, coalesce(scored, 0) as scored,
        round(case when enqueued > 0 then coalesce(scored, 0) / enqueued else 0 end, 6) as caught_up from e full join s using (run_id)""",
    "stream_alerts": BASE
    + _stream_levels("time_bucket(interval 10 minutes, ts)", "10 minutes")
    + f"select window_start, run_id, level_or_rate, steady_samples, {WINDOW_RATE}, case when rate_limited / greatest(steady_samples, 1) > 0.01 "
    "then 'rate_limited' else 'min_samples' end as alert from c where "
    "(rate_limited / greatest(steady_samples, 1) > 0.01 or steady_samples < 20)",
    "stream_late": BASE
    # What came again into a window that the watermark had not passed counts again; the rest was late.
    + """, w as (select time_bucket(interval 10 minutes, ts) as window_start,
        count(*) + coalesce(sum(case when time_bucket(interval 10 minutes, ts) + interval 10 minutes > wm
          then 1 + cast(ts >= wm as int) end), 0)::bigint as requests from timed, mark group by window_start)
      select window_start, requests, ((select 2 * count(*) + count(*) filter (ts >= wm) from timed, mark) - (select sum(requests) from w))::bigint
        as dropped_in_all from w""",
    "stream_dedup": BASE + "select run_id, request_id from timed",
}

# The run block: the single queries joined by run.
_PARTS = {name: ORACLES[name][len(BASE) :] for name in ("run_cost", "eval_coverage", "skip_counts", "sink_summary")}
_RUN_PARTS = f""", counted as ({ORACLES["run_summary"][len(BASE):]}), costs as ({_PARTS["run_cost"]}), judging as ({_PARTS["eval_coverage"]}),
  skipping as ({_PARTS["skip_counts"]})"""
ORACLES["run_summary"] = (
    BASE
    + _RUN_PARTS
    + """ select c.*, k.total_cost_usd, k.cost_per_1k_requests, coalesce(j.judged, 0) as judged, coalesce(j.total_eligible, 0) as total_eligible,
      coalesce(j.dropped, 0) as dropped, coalesce(j.coverage, 0.0) as coverage, coalesce(s.tools_unsupported, 0) as tools_unsupported,
      coalesce(s.vision_unsupported, 0) as vision_unsupported, (select count(*) from levels l where l.run_id = c.run_id) as levels
      from counted c left join costs k using (run_id) left join judging j using (run_id) left join skipping s using (run_id)"""
)
ORACLES["sink_summary"] = (
    BASE
    + _RUN_PARTS
    + f""", listed as ({_PARTS["sink_summary"]}) select l.*, requests, coalesce(tools_unsupported, 0) as tools_unsupported, coalesce(judged, 0) as judged
      from listed l join counted using (run_id) left join judging using (run_id) left join skipping using (run_id)"""
)
