"""Views over the given tables with the shapes that the retrieval operators take; the SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import spread

TABLES = ("documents", "embeddings", "conversations", "events", "part", "nation")


def _name(k: str) -> str:
    """SQL for a name made of letters only, from a number."""
    return f"translate(lpad(cast({k} as varchar(20)), 4, '0'), '0123456789', 'ABCDEFGHIJ')"


def _lines(*parts: str) -> str:
    return f"concat_ws(chr(10), {', '.join(parts)})"


_K = "p_partkey"
VIEWS = {
    "page_v": """
        select source, cast(row_number() over (partition by source order by doc_id) as int) as page_number,
          cast(count(*) over (partition by source) as int) as total_pages, text as content from {documents}""",
    "front_v": f"""
        select concat('doc', {_K}, '.pdf') as source, cast(page as int) as page_number, 6 as total_pages,
          case when page = 1 and {_K} % 4 = 0 then {_lines("concat(upper(p_name), ' SYSTEM')", "concat('for the ', p_type)", f"concat({_name(_K)}, ' WONG')", f"concat({_name(_K + ' + 1')}, ' LEE')", "'Bachelor of Engineering'")}
            when page = 1 and {_K} % 4 = 1 then {_lines("concat(p_name, ' study')", "concat('Mr. ', p_name)", "'Advisor unknown'")}
            when page = 1 and {_K} % 4 = 2 then {_lines("concat('Master thesis on ', p_name)", f"concat({_name(_K)}, ' ROE')", "'body'")}
            when page = 1 then {_lines("p_name", "'second line'", f"concat({_name(_K)}, ' FOX')", "'(Project Proposal)'")}
            when page = 2 and {_K} % 2 = 0 then {_lines("'text'", "concat('Keywords: ', p_type, ', ', p_brand, ' .')")}
            when page = 3 then {_lines("'Supervisory Committee'", "concat('Dr. ', n_name)", "'Advisor'")}
            when page = 4 and {_K} % 3 = 0 then ''
            when page = 5 then concat('Academic year ', cast(2010 + {_K} % 10 as varchar(4)))
            when page = 6 then {_lines("'Keywords: late'", "'Supervisory Committee Dr. Late Advisor'")}
            else 'plain body text' end as content
        from {{part}} join {{nation}} on n_nationkey = {_K} % 25
          join (select 1 as page union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) as pages on page > 0""",
    "point_v": f"""
        select e.vec_id as point_id, e.embedding as vector, d.text as content, d.source as source, concat('Project ', p.p_name) as project_title,
          case when e.vec_id % 3 = 0 then concat({_name("e.vec_id % 40")}, ' WONG, ', {_name("e.vec_id % 7")}, ' LEE') else concat({_name("e.vec_id % 40")}, ' WONG') end as author,
          case when e.vec_id % 5 <> 0 then concat('Dr. ', n.n_name) end as advisor,
          concat(p.p_type, ', ', d.lang) as keywords, cast(2010 + e.vec_id % 10 as varchar(4)) as year
        from (select *, vec_id % (select count(*) from {{part}}) as part_key from {{embeddings}}) e join {{documents}} d on d.doc_id = e.vec_id
          join {{part}} p on p.p_partkey = e.part_key join {{nation}} n on n.n_nationkey = e.vec_id % 25""",
    "question_v": f"""
        select c.conv_id * 100 + c.turn as question_id, concat(
          case c.conv_id % 6 when 0 then concat('author=', lower({_name("c.conv_id % 40")}), ' ')
            when 1 then concat('What did Dr. ', n.n_name, ' supervise in ', cast(2010 + c.conv_id % 10 as varchar(4)), '? ')
            when 2 then concat('ce  project ', p.p_name, ': ')
            when 3 then concat({_name("c.conv_id % 40")}, ' wong methods, ')
            when 4 then concat('(', p.p_type, ') ') else '' end, coalesce(c.text, '')) as question
        from (select *, conv_id % (select count(*) from {{part}}) as part_key from {{conversations}}) c join {{nation}} n on n.n_nationkey = c.conv_id % 25 join {{part}} p on p.p_partkey = c.part_key
        where c.role = 'user'""",
    "aliases": """
        select 'synonym' as kind, 1 as ord, 'ce' as alias, 'computer engineering' as canonical, cast(null as varchar(10)) as pattern union all
        select 'synonym', 2, 'ml', 'machine learning', null union all select 'synonym', 3, 'proj', 'project', null union all
        select 'advisor', 1, 'kenya', 'Dr. KENYA', null union all select 'advisor', 2, 'brazil', 'Dr. BRAZIL', null union all select 'advisor', 3, 'iran', 'Dr. IRAN', null union all
        select 'author', 1, 'aabc', 'AABC WONG', null union all select 'author', 2, 'aade', 'AADE WONG', null union all
        select 'author', 3, null, 'AADI WONG', 'aa+d+i' union all
        select 'staff', 1, 'france', 'Dr. FRANCE', null union all select 'staff', 2, 'peru', 'Dr. PERU', null""",
    "timing_v": "select event_id as question_id, event_type as stage, value as seconds, cast(ts as timestamp) as ts from {events}",
    "raw_answer_v": """
        select conv_id * 100 + turn as question_id, text as raw_answer from {conversations} where role = 'assistant' union all
        select -1, 'Answer: x' union all select -2, 'answer:' union all select -3, '' union all select -4, cast(null as varchar(10)) union all
        select -5, 'I don''t know.' union all select -6, 'Unknown variables are in use' union all select -7, 'Not   found!'""",
}


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """given: tables to read in place of those of the folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("varchar(20)", "string").replace("varchar(10)", "string").replace("varchar(4)", "string")
    tables = {t: given[t] if t in given else view(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if name == "front_v":  # a file of some megabytes is one task's, and its rows become six pages each
        tables["part"] = spread(tables["part"], "p_partkey")
    return spark.sql(sql, **tables)


def with_views(*names: str) -> str:
    """A WITH clause that defines the views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
