"""Benchmark, log and job tables derived from the warehouse tables.

Each view is a list of SQL expressions over one table that Spark and the checking engine both understand, so both
sides start from the same rows. Names in braces are the few functions that differ between them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {"ms": "unix_millis(cast(ts as timestamp))"}
CHECKER = {"ms": "(epoch_us(ts) // 1000)"}

# name -> (table, select expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "bench": (
        "events",
        [
            "concat('t', cast(user_id % 20 as string)) as test",
            "event_type as metric",
            "concat(event_type, '/s') as unit",
            "case when ts < timestamp '2024-01-16 00:00:00' then 'base' else 'tip' end as side",
            "value * case when ts >= timestamp '2024-01-16 00:00:00' and event_type in ('click', 'error')"
            " then 0.3e0 else 1e0 end as value",
            "event_type <> 'error' as more_is_better",
            "case when user_id % 2 = 1 then 'aarch64' else 'x86_64' end as arch",
            "case when ts < timestamp '2024-01-16 00:00:00' then '6.1.141-165' else '6.1.150-174' end as kernel_version",
            "concat('i-', cast(user_id as string)) as instance_id",
            "event_id as ord",
        ],
    ),
    "kernels": (
        "lineitem",
        [
            "concat(l_returnflag, l_linestatus) as metric",
            "concat('u', l_returnflag) as unit",
            "l_extendedprice * case when l_shipdate >= timestamp '1998-01-01 00:00:00' and l_returnflag = 'R' then 0.9e0 else 1e0 end as value",
            "l_linestatus <> 'O' as more_is_better",
            "concat(case when l_shipdate < timestamp '1998-01-01 00:00:00' then '6.10.1-9' when l_suppkey % 7 = 0 then '6.9.2-1'"
            " else '6.12.0-2' end, case l_partkey % 3 when 0 then '.x86_64' when 1 then '.aarch64' else '' end) as kernel_version",
            "case l_partkey % 4 when 0 then 'x86_64' when 1 then 'aarch64' when 2 then 'ARM64' else 'riscv' end as arch",
            "l_orderkey as ord",
        ],
    ),
    "vmlog": (
        "documents",
        [
            "concat('run_', source) as run",
            "concat('i-', cast(doc_id as string)) as instance_id",
            "doc_id",
            "case when doc_id % 29 = 0 then null else concat("
            "case when doc_id % 11 = 0 then 'no payload' else concat('+ aws s3 cp s3://results/run_', source, '/test_', lang,"
            " '/input/', lang, '_test_payload.zip .') end, chr(10),"
            " '+ echo WARNING error', chr(10), '  Warning: disk ', cast(doc_id as string), ' slow', chr(10), text, chr(10),"
            " case when doc_id % 5 = 0 then concat('step FAILED at ', cast(n_chars as string), chr(10), 'Error: again', chr(10),"
            " 'error three', chr(10), 'error four', chr(10)) else '' end,"
            " case when doc_id % 3 <> 0 then 'Test execution completed: SUCCESS' else 'Test execution completed: FAILED' end, chr(10)) end"
            " as content",
        ],
    ),
    "secrets": (
        "documents",
        [
            "doc_id",
            "concat(text, case doc_id % 9"
            " when 0 then concat(' password=', lpad(cast(doc_id as string), 8, '0'))"
            " when 1 then concat(' Authorization: Bearer tok', lpad(cast(doc_id as string), 8, '0'), ' end')"
            " when 2 then concat(' AKIA', lpad(cast(doc_id as string), 16, '0'), ' and ASIA', lpad(cast(doc_id as string), 16, '0'))"
            " when 3 then concat(' ghp_', repeat('a', 36), cast(doc_id as string), ' x')"
            " when 4 then concat(chr(10), '-----BEGIN RSA PRIVATE KEY-----', chr(10), 'MII', cast(doc_id as string), chr(10),"
            " '-----END RSA PRIVATE KEY-----', chr(10), 'after')"
            " when 5 then concat(' ssh-ed25519 AAAA', repeat('b', 60), ' user')"
            " when 6 then concat(' api_key=AKIA', lpad(cast(doc_id as string), 16, '0'), ' t')"
            " when 7 then concat(' eyJhbGci', cast(doc_id as string), '.eyJzdWIi.c2ln ', 'MAC 00:1a:2b password=x')"
            " else '' end) as text",
        ],
    ),
    "consoles": (
        "documents",
        [
            "doc_id",
            "concat(text, case doc_id % 8 when 0 then concat(chr(10), 'Oops: 0000 [#1]', chr(10), 'Call Trace:')"
            " when 1 then ' Kernel panic - not syncing: VFS BUG: x' when 2 then ' call trace:' when 3 then ' rcu_sched detected stalls on CPUs'"
            " when 4 then ' INFO: task kworker blocked for more than 120 seconds' else '' end) as text",
        ],
    ),
    "messages": (
        "events",
        [
            "concat('run', cast(user_id as string)) as run",
            "concat(case when user_id % 10 = 0 then '' else concat('cmd', cast(user_id % 7 as string), '/') end, 'i-', cast(user_id as string),"
            " case event_type when 'error' then '/stderr' when 'signup' then '/other' else '/stdout' end) as stream",
            "cast(ts as timestamp) as ts",
            "{ms} as ts_ms",
            "event_id as seq",
            "case when event_id % 10 = 0 then null when event_type = 'error' and user_id % 3 <> 0 then case event_id % 6"
            " when 1 then concat('Oops : 0', cast(event_id as string)) when 2 then 'BUG: unable' when 3 then 'watchdog: BUG: soft lockup - CPU#2'"
            " when 4 then concat('  INFO: task a:', cast(event_id as string), ' blocked for more than 120s ') when 5 then 'Call Trace:'"
            " else 'DEBUG: fine' end else concat('Booting Linux ', props) end as message",
            "user_id % 30 = 7 and event_type = 'purchase' as stopped",
        ],
    ),
    "stages": (
        "lineitem",
        [
            "concat('run_', cast(l_orderkey % 100 as string)) as run",
            "concat('t', cast(l_orderkey % 5 as string)) as test",
            "concat('i-', cast(l_orderkey as string)) as instance_id",
            "l_linenumber as run_id",
            "cast(case when l_quantity <= 3 then 250 when l_quantity <= 5 then 3 when l_quantity <= 20 then 194 else 0 end as int) as exit_code",
            "cast(l_quantity * 10 as int) as runtime_s",
            "cast(l_orderkey % 4 + 3 as int) as total_runs",
            "case when l_linenumber % 2 = 0 and l_orderkey % 3 = 0 then '6.1' else concat('6.', cast(l_linenumber as string)) end as release",
            "case when l_orderkey % 3 = 0 then 'b1' else l_returnflag end as build",
            "case when l_orderkey % 5 = 0 then null else 'h' end as image_hash",
            "l_partkey * 1000000 + l_suppkey * 1000 + cast(l_quantity as int) as ord",
        ],
    ),
    "results": (
        "orders",
        [
            "concat('n', cast(o_custkey as string)) as node_id",
            "concat('run_', cast(o_custkey % 200 as string)) as run_prefix",
            "case o_orderkey % 4 when 0 then 'baseline' when 1 then ' Boot' when 2 then 'ltp' else 'unix.bench' end as test",
            "concat('i-', cast(o_orderkey as string)) as instance_id",
            "case when o_orderkey % 41 = 0 then '' when o_orderpriority = '1-URGENT' then 'Pass' when o_orderpriority = '2-HIGH' then ' ok '"
            " when o_orderpriority = '3-MEDIUM' and o_orderkey % 7 = 0 then 'FAILED' when o_orderpriority = '5-LOW' then 'skipped'"
            " when o_orderkey % 37 = 0 then 'strange' else 'done' end as raw_status",
            "o_orderkey",
            "o_custkey",
            "o_totalprice",
        ],
    ),
    "objects": (
        "orders",
        [
            "concat('run_', cast(o_custkey % 200 as string), case when o_orderkey % 19 = 0 then '/_config/' else concat('/test_', case o_orderkey % 4 when 0 then 'baseline'"
            " when 1 then ' Boot' when 2 then 'ltp' else 'unix.bench' end, case when o_orderkey % 23 = 0 then '/input/' else '/output/' end) end, 'i-', cast(o_orderkey as string), '/',"
            " case o_orderkey % 3 when 0 then 'console-output.log' when 1 then concat('run-', cast(o_orderkey % 12 as string), '-output.log') else 'result.txt' end) as key",
            "md5(cast(o_orderkey as string)) as md5",
            "o_custkey as size",
            "o_orderkey",
        ],
    ),
    "nodes": (
        "orders",
        [
            "concat('n', cast(o_orderkey as string)) as id",
            "case when o_orderkey % 40 = 7 then 'kbuild' when o_orderkey % 5 = 0 then 'checkout' else 'job' end as kind",
            "case when o_orderkey = 0 or o_orderkey % 101 = 0 then null when o_orderkey % 97 = 0 then 'gone'"
            " else concat('n', cast(cast(floor(o_orderkey / 2) as bigint) as string)) end as parent",
            "case when o_orderstatus = 'P' then 'available' when o_orderstatus = 'O' then 'closing' else 'done' end as state",
            "case when o_orderkey % 6 = 0 then concat('lab:', cast(o_orderkey as string)) else '' end as job_id",
        ],
    ),
    "job_events": (
        "events",
        [
            "concat('n', cast(event_id % 3000 as string)) as node_id",
            "concat('2024-01-', lpad(cast(1 + event_id % 28 as string), 2, '0'), 'T', lpad(cast(user_id % 24 as string), 2, '0'), ':00:00.', lpad(cast(event_id as string), 9, '0')) as stamp",
            "case when event_type = 'signup' then 'node' else 'job' end as kind",
            "case when event_type = 'purchase' then 'running' else 'available' end as state",
            "case when user_id % 3 = 0 then null when user_id % 3 = 1 then 'cloud-1' else 'other' end as runtime",
            "case user_id % 4 when 0 then 'qemu-arm64' when 1 then 'vm-x86' else 'metal' end as platform",
            "case event_id % 5 when 0 then 'file:///job.json' when 1 then null else concat('https://jobs.example/', cast(event_id as string)) end as definition",
        ],
    ),
    "definitions": (
        "orders",
        [
            "concat('node', lpad(cast(o_orderkey as string), 12, '0')) as node_id",
            "o_orderkey",
            "concat('{{\"environment\": {{', case o_orderkey % 5 when 0 then '\"arch\": \"arm64\", ' when 1 then '\"arch\": \"riscv\", ' else '' end,"
            " '\"platform\": \"', case when o_orderkey % 3 = 0 then 'qemu-aarch64' else 'vm' end, '\"}}, \"artifacts\": {{',"
            " case when o_orderkey % 13 = 0 then '' else '\"modules\": \"http://m/m.tar\", ' end,"
            " case o_orderkey % 4 when 0 then '\"rootfs\": \"http://r/r.img\", ' when 1 then '\"ramdisk\": \"http://r/i.cpio\", ' else '' end,"
            " '\"kernel\": \"http://k/', cast(o_orderkey as string), '\"}}, \"tests\": [', case o_orderkey % 3 when 0 then ''"
            " when 1 then '{{\"id\": \"a\", \"type\": \"ltp\"}}, {{\"type\": \"custom\"}}' else '{{\"id\": \"b\", \"type\": \"baseline\"}}' end,"
            " '], \"timeout\": ', case o_orderkey % 6 when 0 then '0' when 1 then '\"x\"' when 2 then '\"900\"' else '1800' end, '}}') as definition",
        ],
    ),
    "configs": (
        "part",
        [
            "concat('run_', cast(p_size as string)) as run",
            "case when p_partkey % 50 = 0 then 'vm' else p_brand end as instance_type",
            "split(case when p_partkey % 3 = 0 then p_name else concat(p_name, ' ', p_type) end, ' ') as test",
            "case when p_partkey % 7 = 0 then null else cast(p_partkey % 4 as int) end as min_count",
            "p_partkey",
        ],
    ),
    "inventory": (
        "supplier",
        [
            "case s_suppkey % 8 when 0 then 'vm' when 1 then 'task' when 2 then 'cluster' when 3 then 'task_definition' when 4 then 'role'"
            " when 5 then 'repo' when 6 then 'log_group' else 'bucket' end as kind",
            "case when s_nationkey % 5 = 0 then 'other-thing' when s_nationkey % 5 = 1 then 'ci-test-7' when s_suppkey % 8 = 4 then 'ecsTaskExecutionRole'"
            " when s_suppkey % 8 = 6 then concat('/ecs/team-', s_name) when s_suppkey % 8 = 2 then 'team-cluster' when s_suppkey % 8 = 5 then 'team-ecr'"
            " else concat('team-', s_name) end as name",
            "case when s_acctbal < 2000 then 'terminated' when s_suppkey % 8 = 1 then 'RUNNING' when s_suppkey % 8 in (2, 3) then 'ACTIVE' else 'running' end as state",
            "s_suppkey",
        ],
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times carry no zone and mean UTC
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*[c.format(**SPARK) for c in columns])


def view_sql(*names: str) -> str:
    """``WITH`` clause defining the named views for the checking engine."""
    parts = []
    for name in names:
        source, columns = VIEWS[name]
        parts.append(f"{name} AS (SELECT {', '.join(c.format(**CHECKER) for c in columns)} FROM {source})")
    return "WITH " + ",\n".join(parts)


def csv_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark files as (path, content): 50 consecutive events make a file, so no file can grow with the data.

    Every other file has its columns turned round and some left out; some rows are short, some fields quoted.
    """
    events = table(spark, sf_dir, "events").selectExpr("*", "cast(floor(event_id / 50) as bigint) as file")
    short = "event_id % 17 = 0"
    metric = "case when event_id % 11 = 0 then '' else event_type end"
    value = "case when event_id % 13 = 0 then 'bad' else cast(value as string) end"
    unit = "case when event_type = 'view' then '\"a, \"\"b\"\"\"' else 'ops' end"
    flag = "case when event_type = 'error' then 'False' else 'True' end"
    kernel = "concat('6.1.', cast(file % 5 as string), '.x86_64')"
    arch = "case when user_id % 2 = 1 then 'ARM64' else 'x86_64' end"
    straight = f"case when {short} then {metric} else concat_ws(',', {metric}, {unit}, {value}, {flag}, {kernel}, concat('i-', cast(file as string)), 'vm', {arch}) end"
    turned = f"case when {short} then {value} else concat_ws(',', {value}, {metric}, {arch}, {unit}) end"
    lines = events.selectExpr("file", "event_id", f"case when file % 2 = 1 then {turned} else {straight} end as line")
    headers = "case when file % 2 = 1 then 'value,metric,arch,unit' else 'metric,unit,value,more_is_better,kernel_version,instance_id,instance_type,arch' end"
    side = "case file % 5 when 0 then 'base-' when 1 then 'base-' when 4 then '' else 'tip-' end"
    path = (
        "concat('run_r', cast(file % 3 as string), '/test_t', cast(file % 20 as string), '/output/i-', cast(file as string),"
        f" '/benchmark-', {side}, '6.1.csv')"
    )
    files = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
    return files.select(F.expr(path).alias("path"), F.concat(F.expr(headers), F.lit("\n"), body, F.lit("\n")).alias("content"))


def kernel_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output files of the ``kernels`` view as (path, content): the rows of 50 consecutive orders make a file.

    Metrics carry the suite's name; of the rows with a true flag some lack it and some leave it blank.
    """
    rows = view(spark, sf_dir, "kernels").selectExpr("*", "cast(floor(ord / 50) as bigint) as file")
    flag = "case when not more_is_better then ',False' when ord % 3 = 0 then '' when ord % 3 = 1 then ',' else ',True' end"
    line = f"concat(concat_ws(',', concat('Byte-UnixBench-6.0.0.', metric), unit, cast(value as string), kernel_version, arch), {flag})"
    files = rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.expr(line))), "\n").alias("body"))
    path = "concat('run_k', cast(file % 3 as string), '/test_ub/output/i-', cast(file as string), '/benchmark-6.1.csv')"
    head = F.lit("metric,unit,value,kernel_version,arch,more_is_better\n")
    return files.select(F.expr(path).alias("path"), F.concat(head, "body", F.lit("\n")).alias("content"))


def unixbench_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw suite logs: results of a document around its text, with result-like lines outside the result section."""
    docs = table(spark, sf_dir, "documents")
    timing = F.lit(" (10.0 s, 7 samples)")
    chars = F.col("n_chars").cast("string")
    early = F.lit("Dhrystone 2 using register variables 1.0 lps (10.0 s, 7 samples)\n")
    text = F.regexp_replace("text", r"\s+", "_")
    first = F.concat(F.lit("Arithmetic Test (double)   "), chars, F.lit(" lps  "), timing, F.lit("\n\n"))
    second = F.concat(F.lit("Test "), "lang", F.lit("\t"), (F.col("n_chars") / 2).cast("string"), F.lit(" KBps"), timing, F.lit("\n"))
    index = F.lit("\nSystem Benchmarks Index Values   BASELINE RESULT INDEX\nLate Test 9.0 lps (10.0 s, 7 samples)\n")
    return docs.select("doc_id", F.concat(text, F.lit("\n"), early, first, text, F.lit("\n"), second, index).alias("content"))
