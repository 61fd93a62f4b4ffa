"""The registered queries as SQL for DuckDB: a chain of common views, and a body each."""

from __future__ import annotations

import re



def _added(clause: str, columns: str) -> str:
    """Columns with those of an addition [name, type, after]: < is at the front, > at the end; none if the name is there."""
    names = f"list_transform({columns}, lambda x: split_part(x,' ',1))"
    at = f"case {clause}[3] when '<' then 0 else coalesce(nullif(list_position({names}, {clause}[3]),0), len({columns})) end"
    return f"case when {clause} is null or list_contains({names}, {clause}[1]) then {columns} else list_concat(list_concat(({columns})[1:{at}], [{clause}[1]||' '||{clause}[2]]), ({columns})[{at}+1:]) end"


_NULLS = "cast(null as varchar), cast(null as varchar), cast(null as bigint), cast(null as varchar), cast(null as double), cast(null as varchar)"
_VIEWS = {
    "cl_rows": """select event_id, cast(floor(event_id/4) as bigint) as tx, cast(floor(event_id/4) as bigint)*6+1+event_id%4 as slot,
        case when user_id%5=0 then 'audit' else 'user_state' end as tbl, user_id, event_type, value, props,
        case when event_type='error' then 'DELETE'
             when lag(event_type) over (partition by user_id order by event_id) is null or lag(event_type) over (partition by user_id order by event_id)='error' then 'INSERT'
             else 'UPDATE' end as op from events""",
    "cl": f"""select slot, tx, 'row' as kind, tbl, op, user_id, event_type, value, props from cl_rows
        union all select distinct tx*6, tx, 'tx_begin', {_NULLS} from cl_rows where tx%11<>3
        union all select distinct tx*6+5, tx, 'tx_commit', {_NULLS} from cl_rows where tx%13<>5""",
    "log": """select 'mysql-bin-changelog.'||lpad(cast(cast(floor(slot/600) as bigint)+1 as varchar),6,'0') as binlog_file, 4+128*(slot%600+1) as position, * from cl""",
    "env": """select *, 'mysql:'||binlog_file||':'||cast(position as varchar)||':'||kind||':'||coalesce('user_id='||cast(user_id as varchar),'') as idempotency_key,
        'mysql:app:'||tbl||':user_id='||cast(user_id as varchar) as dedup_key from log""",
    "delivered": """select slot as delivery_seq, env.* from env union all select slot+1000000000, env.* from env where tx%10=0""",
    "hist": """select 'user_state' as h_tbl, 'mysql-bin-changelog.000001' as h_file, 1000 as h_pos, 1 as version, 3 as ncols
        union all select 'user_state', 'mysql-bin-changelog.000002', 4, 2, 4 union all select 'audit', 'mysql-bin-changelog.000001', 4, 1, 3""",
    "hist_iv": """select *, lead(h_file) over (partition by h_tbl order by h_file, h_pos) as n_file, lead(h_pos) over (partition by h_tbl order by h_file, h_pos) as n_pos,
        row_number() over (partition by h_tbl order by h_file, h_pos) as rn from hist""",
    "log_w": """select *, case when tbl='user_state' and binlog_file>='mysql-bin-changelog.000002' then 4 when tbl='audit' and binlog_file>='mysql-bin-changelog.000003' then 4 else 3 end as width
        from log where kind='row'""",
    "decoded": """select l.*, h.version, h.ncols from log_w l left join hist_iv h on l.tbl=h.h_tbl
        and (h.rn=1 or l.binlog_file>h.h_file or (l.binlog_file=h.h_file and l.position>=h.h_pos))
        and (h.n_file is null or l.binlog_file<h.n_file or (l.binlog_file=h.n_file and l.position<h.n_pos))""",
    "idx": "select 0 as i union all select 1 union all select 2 union all select 3",
    "raw_rows": """select l.*, lag(event_type) over (partition by user_id order by slot) as was_type, lag(props) over (partition by user_id order by slot) as was_props,
        lag(value) over (partition by user_id order by slot) as was_value from decoded l""",
    "env_rows": """select *, case when op<>'INSERT' then img(ncols, width, user_id, was_type, was_props, was_value) else '' end as before_image,
        case when op<>'DELETE' then img(ncols, width, user_id, event_type, props, value) else '' end as after_image,
        case when ncols=width then cast(user_id as varchar) end as key_value from raw_rows""",
    "raw_all": """select binlog_file, position, kind, tbl, tx from log union all select 'mysql-bin-changelog.000002', 4, 'schema', 'user_state', null""",
    "raw_tx": """select *, case when tx is not null then row_number() over (partition by tx order by binlog_file, position) end as rn, case when tx is not null then count(*) over (partition by tx) end as cnt,
        max(case when kind='tx_begin' then 1 else 0 end) over (partition by tx)=1 and tx is not null as begun, max(case when kind='tx_commit' then 1 else 0 end) over (partition by tx)=1 and tx is not null as done from raw_all""",
    "snap": """select user_id, case when user_id%5=0 then 'audit' else 'user_state' end as tbl, 'mysql-bin-changelog.000001' as binlog_file, 4 as position from
        (select distinct user_id from events where user_id<100 union all select distinct user_id+100000 from events where user_id<20) s""",
    # what each statement does, by its number
    "edits": """select 't'||cast(user_id as varchar) as tbl, row_number() over (partition by user_id order by event_id) as i, 'mysql-bin-changelog.'||lpad(cast(event_id//600+1 as varchar),6,'0') as binlog_file,
        132+128*(event_id%600) as position, case when k=9 and n='0' then 'drop' when k in (5,6) then 'count' when k=10 then 'create' else 'alter' end as does,
        case k when 2 then 'c'||n when 8 then 'd'||n when 11 then 'IF' end as dropped, case k when 2 then 'name' when 8 then 'v' end as modified, case k when 2 then 'TEXT' when 8 then 'BIGINT' end as modified_to,
        case k when 3 then 'c'||n when 9 then 'id' end as changed, case k when 3 then 'e'||n||' BIGINT UNSIGNED' when 9 then 'id BIGINT' end as changed_to,
        case k when 0 then ['c'||n, 'INT', 'name'] when 1 then ['d'||n, 'DECIMAL(10, 2)', '<'] when 4 then ['a'||n, 'INT', 'v'] when 7 then ['INDEX', 'i'||n, '>'] when 12 then ['first'||n, 'INT', '>'] end as add1,
        case k when 4 then ['b'||n, 'INT', 'v'] end as add2 from (select *, (event_id//3)%13 as k, cast(event_id%5 as varchar) as n from events where event_id%3=0) e""",
    "fold": f"""select 't'||cast(user_id as varchar) as tbl, cast(0 as bigint) as i, 'mysql-bin-changelog.000001' as binlog_file, cast(4 as bigint) as position, user_id%7<>0 as known,
        case when user_id%7<>0 then ['id INT', 'name VARCHAR(255)', 'v INT'] else cast([] as varchar[]) end as cols, case when user_id%7<>0 then ['id'] else cast([] as varchar[]) end as keys, case when user_id%7<>0 then 1 end as version from (select distinct user_id from events) u
        union all select tbl, i, binlog_file, position, does<>'drop' and (known or does='create'), case when does='drop' or not known then cast([] as varchar[]) when does='alter' then {_added("add2", _added("add1", "c3"))} else cols end,
        case when does='drop' or not known then cast([] as varchar[]) when does='alter' then k1 else keys end, case when does='drop' or (not known and does<>'create') then null when not known then 1 else version+1 end from (
        select *, list_transform(c1, lambda x: case when split_part(x,' ',1)=modified then modified||' '||modified_to when split_part(x,' ',1)=changed then changed_to else x end) as c3 from (
        select e.*, f.known, f.cols, f.keys, f.version, list_filter(f.cols, lambda x: split_part(x,' ',1) is distinct from e.dropped) as c1, list_filter(f.keys, lambda x: x is distinct from e.dropped) as k1 from fold f join edits e on e.tbl=f.tbl and e.i=f.i+1) a) b""",
    "in_lanes": "select user_id%16 as lane, event_id, ts, row_number() over (partition by user_id%16 order by ts, event_id) as i from events",
    # a row after another: a batch that is full or too old ends before the next
    "lanes": """select lane, i, event_id, ts, ts as oldest, 1 as n, cast(0 as bigint) as batch_no from in_lanes where i=1
        union all select e.lane, e.i, e.event_id, e.ts, case when l.n=16 or e.ts-l.oldest>=interval 4 hour then e.ts else l.oldest end, case when l.n=16 or e.ts-l.oldest>=interval 4 hour then 1 else l.n+1 end,
        case when l.n=16 or e.ts-l.oldest>=interval 4 hour then l.batch_no+1 else l.batch_no end from lanes l join in_lanes e on e.lane=l.lane and e.i=l.i+1""",
    "versions": "select * from fold where i>0 or known",
}
_BEGUN, _DONE = "(select tx from log where kind='tx_begin')", "(select tx from log where kind='tx_commit')"
_BODIES = {
    "op_counts": "select tbl, op, count(*) as n from log where kind='row' group by tbl, op",
    "table_filter": "select kind, count(*) as n from log where kind<>'row' or tbl='user_state' group by kind",
    "envelope_keys": "select idempotency_key, dedup_key from env",
    "unique_events": "select idempotency_key, min(delivery_seq) as delivery_seq from delivered group by idempotency_key",
    "duplicates": "select idempotency_key, delivery_seq from (select *, row_number() over (partition by idempotency_key order by delivery_seq) rn from delivered) t where rn>1",
    "latest_by_dedup_key": "select dedup_key, op, position from (select *, row_number() over (partition by dedup_key order by binlog_file desc, position desc, delivery_seq) rn from delivered where dedup_key is not null) t where rn=1",
    "materialized_view": "select user_id, event_type, value from (select *, row_number() over (partition by tbl,user_id order by binlog_file desc, position desc) rn from env where kind='row') t where rn=1 and op<>'DELETE'",
    "tx_batches": "select tx, cast(sum(case when kind='row' then 1 else 0 end) as bigint) as row_count, max(slot) as mx from log group by tx having max(case when kind='tx_begin' then 1 else 0 end)=1 and max(case when kind='tx_commit' then 1 else 0 end)=1",
    "tx_pending": "select tx, count(*) as n from log group by tx having max(case when kind='tx_begin' then 1 else 0 end)=1 and max(case when kind='tx_commit' then 1 else 0 end)=0",
    "non_tx_orphans": "select l.slot, l.kind from log l left join (select tx from log where kind='tx_begin') b on l.tx=b.tx where b.tx is null",
    "size_batches": "select cast(floor((rn-1)/100) as bigint) as batch_no, count(*) as n, max(binlog_file) as f from (select *, row_number() over (order by slot) rn from log where kind='row') t group by 1",
    "resume_from": "select count(*) as n from log where binlog_file>'mysql-bin-changelog.000002' or (binlog_file='mysql-bin-changelog.000002' and position>=4+128*300)",
    "before_after": """select tbl as "table", binlog_file, position, cast(user_id as varchar) as user_id, ncols<>width as anonymous, cast(cast(round(was_value*100) as bigint) as varchar) as before_value, cast(cast(round(value*100) as bigint) as varchar) as after_value from raw_rows where op='UPDATE'""",
    "schema_asof": "select tbl, version, width, count(*) as n from decoded group by tbl, version, width",
    "decoded_columns": """select slot, i, case when ncols=width then case when i=0 then 'user_id' when i=1 then 'event_type' when i=2 and width=4 then 'props' else 'value' end else 'col_'||cast(i as varchar) end as col_name,
        case when i=0 then cast(user_id as varchar) when i=1 then event_type when i=2 and width=4 then props else cast(cast(round(value*100) as bigint) as varchar) end as col_value from decoded cross join idx where i<width""",
    "snapshot_union": "select kind, count(*) as n from (select 'snapshot' as kind from snap union all select kind from log) t group by kind",
    "snapshot_overlap_latest": """select dedup_key, kind from (select *, row_number() over (partition by dedup_key order by binlog_file desc, position desc, delivery_seq) rn from (
        select 'mysql:app:'||tbl||':user_id='||cast(user_id as varchar) as dedup_key, 'snapshot' as kind, binlog_file, position, -1 as delivery_seq from snap
        union all select dedup_key, kind, binlog_file, position, slot from env where kind='row') u) t where rn=1""",
    "snapshot_idempotency_overlap": """select count(*) as n, count(distinct k) as n_keys from (select 'mysql:'||binlog_file||':'||cast(position as varchar)||':snapshot:user_id='||cast(user_id as varchar) as k from snap
        union all select idempotency_key from env where kind='row') t""",
    "offset_progress": "select delivery_seq, max(slot) over (order by delivery_seq rows between unbounded preceding and current row) as committed_slot from delivered",
    "tx_cap": f"""select tx, cast(sum(case when r<=4 then 1 else 0 end) as bigint) as partial_events, cast(sum(case when r>4 then 1 else 0 end) as bigint) as orphan_events from
        (select *, row_number() over (partition by tx order by slot) r from log where tx in {_BEGUN}) t group by tx having count(*)>=4""",
    "sink_dedup_anti": "select e.idempotency_key from env e left join (select idempotency_key as k from env where tx%2=0) s on e.idempotency_key=s.k where s.k is null",
    "webhook_payload_meta": f"""select tx, count(*) as event_count, max(binlog_file) as max_binlog_file, max(position) filter (binlog_file=top) as max_binlog_position, case when count(distinct tx)=1 then max(tx) end as transaction_id
        from (select *, max(binlog_file) over (partition by tx) as top from log) t where tx in {_BEGUN} and tx in {_DONE} group by tx""",
    "delivery_stats": f"""select (select count(*) from log) as events_submitted, (select count(*) from log where tx in {_BEGUN} and tx in {_DONE}) as tx_events_delivered,
        (select count(*) from log where tx not in {_BEGUN}) as non_tx_events,
        (select count(*) from (select tx from log group by tx having max(case when kind='tx_begin' then 1 else 0 end)=1 and max(case when kind='tx_commit' then 1 else 0 end)=0) p) as pending_transactions""",
    "batch_idempotency_key": "select tx, sha256(string_agg(idempotency_key,'|' order by idempotency_key)) as batch_key from env group by tx",
    "envelope_rows": """select 'mysql' as source, 'app' as database, tbl as "table", op as change_type, before_image, after_image, 'user_id='||coalesce(key_value,'~') as key_text, binlog_file, position, cast(slot as double) as event_ts,
        'tx-'||cast(tx as varchar) as transaction_id, 'mysql:'||binlog_file||':'||cast(position as varchar)||':row:user_id='||coalesce(key_value,'None') as idempotency_key, 'mysql:app:'||tbl||':user_id='||coalesce(key_value,'None') as dedup_key from env_rows""",
    "envelope_types": """select col_name, data_type, sum(k) as n from (
        select case when ncols=width then case when i=0 then 'user_id' when i=1 then 'event_type' when i=2 and width=4 then 'props' else 'value' end else 'col_'||cast(i as varchar) end as col_name,
        case when ncols=width then 'VARCHAR(64)' end as data_type, case when op='UPDATE' then 2 else 1 end as k from decoded cross join idx where i<width) t group by 1, 2""",
    "envelope_marks": """select kind as event_type, cast(null as varchar) as "table", cast(null as varchar) as ddl_statement, cast(null as int) as schema_version,
        case when kind='tx_commit' then (select count(*) from log r where r.kind='row' and r.tx=l.tx) end as row_count, binlog_file, position, 'tx-'||cast(tx as varchar) as transaction_id,
        'mysql:'||binlog_file||':'||cast(position as varchar)||':'||kind||':' as idempotency_key, cast(null as varchar) as dedup_key, cast(null as int) as key_size from log l where kind<>'row'
        union all select 'schema', 'user_state', 'ALTER TABLE app.user_state ADD COLUMN props TEXT AFTER event_type', 2, null, 'mysql-bin-changelog.000002', 4, null, 'mysql:mysql-bin-changelog.000002:4:schema:', null, null""",
    "filtered_row_counts": """select row_count, count(*) as n from (select (select count(*) from log r where r.kind='row' and r.tx=l.tx and r.tbl<>'user_state') as row_count from log l where kind='tx_commit') t group by row_count""",
    "event_json": """select cast(to_json({'event_type': kind, 'change_type': op, 'schema_version': v, 'row_count': n, 'binlog_file': binlog_file, 'position': position, 'transaction_id': 'tx-'||cast(tx as varchar), 'dedup_key': dk}) as varchar) as value from (
        select 'row' as kind, op, cast(null as int) as v, cast(null as bigint) as n, binlog_file, position, tx, 'mysql:app:'||tbl||':user_id='||coalesce(key_value,'None') as dk from env_rows
        union all select kind, null, null, case when kind='tx_commit' then (select count(*) from log r where r.kind='row' and r.tx=l.tx) end, binlog_file, position, tx, null from log l where kind<>'row'
        union all select 'schema', null, 2, null, 'mysql-bin-changelog.000002', 4, null, null) t""",
    "images_as_maps": """select binlog_file, position, width + case when ncols=width then 0 else 1 end as n, 'again' as event_type, key_value as user_id from env_rows where op='INSERT'""",
    "snapshot_envelope_rows": """select 'snapshot' as event_type, tbl as "table", 'user_id='||cast(user_id as varchar)||'|twice='||cast(user_id*2 as varchar) as after_image, binlog_file, cast(position as bigint) as position, cast(null as varchar) as transaction_id,
        'mysql:'||binlog_file||':4:snapshot:user_id='||cast(user_id as varchar) as idempotency_key, 'mysql:app:'||tbl||':user_id='||cast(user_id as varchar) as dedup_key from snap""",
    "snapshot_schema": """select 'app' as database, tbl as "table", 'mysql-bin-changelog.000001' as binlog_file, cast(4 as bigint) as position, 1 as version, 'id' as key_columns, cast(i as integer) as i, col_name,
        case when i=0 then 'bigint unsigned' else 'decimal(10,2)' end as data_type, i=0 as in_key, i>0 as nullable from (
        select distinct 't'||cast(user_id as varchar) as tbl, 0 as i, 'id' as col_name from events
        union all select 't'||cast(user_id as varchar), row_number() over (partition by user_id order by event_type), event_type from (select distinct user_id, event_type from events) e) t where tbl not in ('t3','t5')""",
    "snapshot_page": "select user_id, tbl from snap order by user_id, tbl limit 20 offset 60",
    "binlog_records": """select kind, operation, "table", binlog_file, position, case when is_open then 'tx-'||binlog_file||'-'||cast(b as varchar) when kind='tx_commit' then 'tx-'||binlog_file||'-'||cast(position as varchar) end as transaction_id,
        case when op<>'INSERT' then cast(user_id as varchar) end as before_id, case when op<>'DELETE' then cast(user_id as varchar) end as after_id from (
        select *, case when kind='row' then op end as operation, case when kind='row' then tbl end as "table", coalesce(b>coalesce(e,-1),false) as is_open from (
        select *, max(case when kind='tx_begin' then position end) over (partition by binlog_file order by position rows between unbounded preceding and current row) as b,
        max(case when kind='tx_commit' then position end) over (partition by binlog_file order by position rows between unbounded preceding and 1 preceding) as e from log) x) y
        cross join (select 1 as k union all select 2) z where (k=1 or (kind='row' and user_id%7=0)) and not (kind='tx_commit' and tx%2=1 and not is_open)""",
    "statement_kinds": r"""select event_id, case when q like 'BEGIN%' then 'tx_begin' when q like 'COMMIT%' then case when event_id%2=0 then 'tx_commit' end else 'schema' end as kind,
        replace(replace(split_part(coalesce(nullif(regexp_extract(query, '(?i)ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?([`"\w.]+)', 1),''), nullif(regexp_extract(query, '(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([`"\w.]+)', 1),''),
        nullif(regexp_extract(query, '(?i)DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?([`"\w.]+)', 1),''), nullif(regexp_extract(query, '(?i)RENAME\s+TABLE\s+(?:IF\s+EXISTS\s+)?([`"\w.]+)', 1),''), nullif(regexp_extract(query, '(?i)TRUNCATE\s+(?:TABLE\s+)?([`"\w.]+)', 1),'')), '.', -1),'`',''),'"','') as table_name
        from (select event_id, query, upper(trim(query)) as q from (select event_id, replace((['BEGIN', ' begin work', 'COMMIT', 'commit', 'ROLLBACK', 'SAVEPOINT a', 'ALTER TABLE `app`.`{t}` ADD c INT', 'create table if not exists app.{t} (id INT)',
        'DROP TABLE IF EXISTS {t}', 'RENAME TABLE {t} TO b', 'TRUNCATE app.{t}', 'TRUNCATE TABLE {t}', 'CREATE DATABASE q', ''])[event_id%14+1], '{t}', 't'||cast(user_id as varchar)) as query from events) v) t""",
    "ddl_filter": """select kind, table_name, count(*) as n from (select kind, tbl as table_name from log where kind='row' and tbl<>'audit' union all select kind, '?' from log where kind<>'row'
        union all select 'schema', 'user_state' union all select 'schema', case when user_id%10=0 then '' else 't'||cast(user_id as varchar) end from events where event_id%3=0 and user_id not in (3, 15)) x group by 1, 2""",
    "boundaries_off": "select kind, count(*) as n, cast(0 as bigint) as in_transactions from raw_all where kind in ('row','schema') group by kind",
    "tx_assembly": """select tx, kinds, slots, n, cut, max_file, position as max_pos from (
        select tx, string_agg(kind, ',' order by slot) as kinds, string_agg(cast(slot as varchar), ',' order by slot) as slots, count(*) as n, not bool_or(kind='tx_commit') as cut, max(binlog_file) as max_file, max(slot) as top from (
        select *, row_number() over (partition by tx order by slot) as rn from log where tx in (select tx from log where kind='tx_begin')) t where rn<=5 group by tx) g join (select slot, position from log) p on g.top=p.slot where n>4 or not cut""",
    "delivery_batches": """select delivery_batch, pending, count(*) as n, min(position) as least_position from (
        select case when (done and cnt<=5) or cnt>4 then 'tx-tx-'||cast(tx as varchar) end as delivery_batch, not ((done and cnt<=5) or cnt>4) as pending, position from raw_tx where begun and rn<=5
        union all select 'loose-'||cast(cast(floor((row_number() over (order by binlog_file, position)-1)/50) as bigint) as varchar), false, position from raw_tx where not begun or rn>5) t group by 1, 2""",
    "delivery_summary": """select (select count(*) from (select distinct tx from raw_tx where begun and done)) + (select cast(ceil(count(*)/50) as bigint) from raw_tx where not begun) as batches_delivered,
        count(*) filter (not begun or done) as events_delivered, count(*) filter (begun and not done) as events_pending, max(binlog_file) filter (not begun or done) as last_binlog_file,
        max(position) filter ((not begun or done) and binlog_file=(select max(binlog_file) from raw_tx where not begun or done)) as last_position from raw_tx""",
    "batch_offsets": """select batch_no, max(binlog_file) as max_file, max(position) filter (binlog_file=top) as max_pos from (
        select *, max(binlog_file) over (partition by batch_no) as top from (select *, cast(floor((row_number() over (order by delivery_seq)-1)/70) as bigint) as batch_no from delivered where kind='row') x) t group by batch_no""",
    "mixed_payloads": """select batch, count(*) as event_count, max(binlog_file) as max_binlog_file, max(position) filter (binlog_file=top) as max_binlog_position, case when count(distinct tx)=1 then max(tx) end as transaction_id,
        sha256(string_agg(idempotency_key,'|' order by idempotency_key)) as batch_key from (select *, max(binlog_file) over (partition by batch) as top from (select *, case when tx%3=0 then tx else cast(floor(tx/10) as bigint)*10+1 end as batch from env) e) t group by batch""",
    "stream_loose_batches": """select lane, batch_no, cast(count(*) as integer) as n_events, arg_min(event_id, i) as first_seq, arg_max(event_id, i) as last_seq, case when count(*)=16 then 'size' else 'age' end as reason
        from lanes group by lane, batch_no having count(*)=16 or min(ts)+interval 4 hour<=(select max(ts) from events) or batch_no<(select max(batch_no) from lanes l where l.lane=lanes.lane)""",
    "stream_resume_from": "select slot, kind, position, binlog_file from log where binlog_file>'mysql-bin-changelog.000002' or (binlog_file='mysql-bin-changelog.000002' and position>=4+128*300)",
    "sink_published": "select tx, kind, binlog_file, position, idempotency_key from env",
    "stream_unique_events": "select distinct idempotency_key from delivered",
    "snapshot_splits": "select cast(16 as bigint) as n_ranges, count(*) as n_rows, count(distinct (l_orderkey, l_linenumber)) as n_keys, cast(sum(l_quantity) as double) as quantity, true as even from lineitem",
    "ddl_history": """select 'app' as database, tbl as "table", binlog_file, position, version, case when known then array_to_string(cols, ', ') end as columns, case when known then array_to_string(keys, ',') end as key from versions""",
    "ddl_versions": """select 'app' as database, tbl as "table", cast(coalesce(arg_max_null(version, i), 0) as integer) as schema_version from versions group by tbl""",
}


def _expanded(sql: str) -> str:
    """``img(ncols, width, user_id, type, props, value)``: an image as name=value parts, anonymous where widths differ."""

    def image(m: re.Match) -> str:
        ncols, width, user, kind, props, value = (x.strip() for x in m[1].split(","))
        cells = [f"cast({user} as varchar)", f"coalesce({kind},'~')", f"coalesce({props},'~')", f"coalesce(cast(cast(round({value}*100) as bigint) as varchar),'~')"]
        known = f"'user_id='||{cells[0]}||'|event_type='||{cells[1]}||case when {width}=4 then '|props='||{cells[2]} else '' end||'|value='||{cells[3]}"
        other = f"'col_0='||{cells[0]}||'|col_1='||{cells[1]}||case when {width}=4 then '|col_2='||{cells[2]}||'|col_3=' else '|col_2=' end||{cells[3]}"
        return f"(case when {ncols}={width} then {known} else {other} end)"

    return re.sub(r"img\(([^)]*)\)", image, sql)


def _needed(sql: str) -> list[str]:
    """The views that a statement reads, each after those that it reads itself."""
    out: list[str] = []
    for name in _VIEWS:
        if name not in out and re.search(rf"\b{name}\b", sql):
            out += [x for x in [*_needed(_VIEWS[name].replace(f"from {name} ", "")), name] if x not in out]
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in _BODIES.items():
        views = ",\n".join(f"{v} as {'' if v in ('fold', 'lanes') else 'materialized '}({_expanded(_VIEWS[v])})" for v in _needed(body))
        out[name] = f"with recursive {views}\n{body}" if views else body
    # the same rows, by streams and by other ways
    return out | {f"stream_{n}": out[n] for n in ("tx_assembly", "materialized_view")} | {"delivery_measured": out["delivery_summary"], "schema_asof_ranges": out["schema_asof"], "sink_dedup_index": out["sink_dedup_anti"], "snapshot_chunks": out["materialized_view"]}
