"""Views that give the driver's tables the shapes of the operators.

Each text is run by Spark and, in `plans.oracle`, by DuckDB."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.session import read_spread

# A synthetic source tree: one file per document.
FILES = """
select doc_id, lang as sid,
  concat('/src/', source, '/', case when doc_id % 23 = 0 then '.cache/' else '' end,
    case when doc_id % 17 = 0 then '_' else '' end, 'f', cast(doc_id as string),
    case cast(doc_id % 14 as int)
      when 0 then '.c' when 1 then '.h' when 2 then '.cpp' when 3 then '.cc'
      when 4 then '.py' when 5 then '.js' when 6 then '.ts' when 7 then '.java'
      when 8 then '.go' when 9 then '.rs' when 10 then '.sh' when 11 then '.md'
      when 12 then '.PY' else '' end) as file_path,
  1700000000 + doc_id * 60 as mtime,
  case when doc_id % 14 in (0, 1)
       then concat('int fn_', cast(doc_id as string), '(int a) {{', chr(10), text, chr(10),
                   'curl_easy_init();', chr(10), 'sqlite3_exec(db, "SELECT 1");', chr(10), '}}', chr(10))
       when doc_id % 14 in (4, 12)
       then concat('def fn_', cast(doc_id as string), '(x):', chr(10), text, chr(10),
                   'cursor.execute("SELECT 1")', chr(10))
       else text end as content
from {documents}
"""

# Three scans of a tree: files appear late, vanish and change.
SCANS = """
select scan_no, concat('/src/', source, '/f', cast(doc_id as string), '.py') as file_path,
  1700000000 + doc_id * 60
    + case when scan_no >= 2 and doc_id % 5 = 0 then 100 else 0 end
    + case when scan_no >= 3 and doc_id % 7 = 0 then 100 else 0 end as mtime
from (select cast(1 as bigint) as scan_no, doc_id, source from {documents}
      union all select cast(2 as bigint), doc_id, source from {documents}
      union all select cast(3 as bigint), doc_id, source from {documents})
where not (doc_id % 20 = 18 and scan_no = 1)
  and not (doc_id % 20 = 19 and scan_no = 3)
"""

# Build log lines from events.
LOG_LINES = """
select concat('u', cast(user_id as string)) as sid, cast(ts as date) as log_day, event_id, user_id, event_type,
  case
    when user_id % 5 = 0 and event_type = 'error' then
      concat('Traceback (most recent call last):', chr(10),
             '  File "a_', cast(user_id as string), '.py", line ', cast(event_id % 90 + 1 as string), ', in <module>', chr(10),
             '  File "b_', cast(user_id as string), '.py", line ', cast(event_id % 70 + 1 as string), ', in f', chr(10),
             'ValueError: bad: ', cast(event_id % 50 as string), chr(10))
    when event_type = 'error' then
      concat('src/m', cast(user_id % 7 as string), '.c:', cast(event_id % 500 + 1 as string), ':',
             cast(event_id % 80 + 1 as string), ': error: bad value ', cast(event_id % 50 as string))
    when event_type = 'view' then
      concat('src/m', cast(user_id % 7 as string), '.c:', cast(event_id % 500 + 1 as string), ':',
             cast(event_id % 80 + 1 as string), ': warning: unused: v', cast(event_id % 9 as string))
    when event_type = 'click' then
      concat('src/m', cast(user_id % 7 as string), '.c:', cast(event_id % 500 + 1 as string), ':1: note: declared here')
    when event_type = 'signup' then '  indented: 1: 2: skipped: line'
    else concat(cast(event_id % 90 + 10 as string), ':3: error: digits: skipped') end as line
from {events}
"""

# One log per session name and day.
LOGS = """
select sid, log_day, 1700000000 + min(event_id) as timestamp, concat('$ make ', sid, chr(10), {concatenated}) as output
from {log_lines} group by sid, log_day
"""

# Every text is logged whole; those of odd conversations again, later and in another session.
DECISIONS = """
select concat('s', cast((conv_id + 3 * again) % 10 as string)) as sid, role as key, text as value,
  concat('turn ', cast(turn % 2 as string)) as rationale,
  1700000000 + (conv_id % 50) * 100 + turn + 10000 * again as timestamp,
  cast(case when role = 'user' then 1.0 else 0.95 end as double) as confidence,
  case when role = 'user' then 0 else 2 end as source,
  conv_id * 1000 + turn + 500 * again as ordinal
from (select *, cast(0 as bigint) as again from {conversations}
      union all select *, cast(1 as bigint) from {conversations} where conv_id % 2 = 1)
"""

# Passages, the same passages as plain word lists, and upper-case folder names.
QUERIES = """
select item_id as query_id, text as query_text from {benchmark}
union all
select 1000000 + item_id, trim(regexp_replace(text, '[^0-9A-Za-zÀ-ɏ]+', ' '{all})) from {benchmark}
union all
select 2000000 + min(doc_id), upper(source) from {documents} group by source
"""


# What is added to the id of a query that names sessions.
NAMED = 10_000_000

# Three queries by clauses for each source.
CLAUSES = """
with s as (select source, min(doc_id) as first from {documents} group by source)
select 3 * first as query_id, source as query_text, array(
  named_struct('op', 'any', 'field', cast(null as string), 'tokens', array(source, 'curl')),
  named_struct('op', 'not', 'field', 'content', 'tokens', array('la', 'der'))) as clauses from s
union all
select 3 * first + 1, source, array(
  named_struct('op', 'phrase', 'field', 'content', 'tokens', array('select', '1')),
  named_struct('op', 'all', 'field', 'file_path', 'tokens', array('src', source))) from s
union all
select 3 * first + 2, source, array(
  named_struct('op', 'prefix', 'field', cast(null as string), 'tokens', array('cur', 'sqlit')),
  named_struct('op', 'all', 'field', cast(null as string), 'tokens', array(source, 'the'))) from s
"""


def clause_queries(spark, sf_dir) -> DataFrame:
    return spark.sql(CLAUSES, documents=table(spark, sf_dir, "documents"))


def clause_queries_in_sessions(spark, sf_dir) -> DataFrame:
    """Each of all sessions, and under a second id of two by name."""
    asked = clause_queries(spark, sf_dir)
    named = asked.withColumns({"query_id": F.col("query_id") + NAMED, "sid": F.explode(F.array(F.lit("de"), F.lit("en")))})
    return asked.withColumn("sid", F.lit(None).cast("string")).unionByName(named)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/{name}.parquet")


def files(spark, sf_dir) -> DataFrame:
    return spark.sql(FILES, documents=table(spark, sf_dir, "documents"))


def scans(spark, sf_dir) -> DataFrame:
    return spark.sql(SCANS, documents=table(spark, sf_dir, "documents"))


def log_lines(spark, sf_dir) -> DataFrame:
    return spark.sql(LOG_LINES, events=table(spark, sf_dir, "events"))


def logs(spark, sf_dir) -> DataFrame:
    return spark.sql(LOGS.replace("{concatenated}", "listagg(line, chr(10)) within group (order by event_id)"),
                     log_lines=log_lines(spark, sf_dir))


def decisions(spark, sf_dir) -> DataFrame:
    return spark.sql(DECISIONS, conversations=table(spark, sf_dir, "conversations"))


def queries(spark, sf_dir) -> DataFrame:
    return spark.sql(QUERIES.replace("{all}", ""), benchmark=table(spark, sf_dir, "benchmark"),
                     documents=table(spark, sf_dir, "documents"))


def passages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
