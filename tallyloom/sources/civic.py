"""Civic tables over the driver's star schema.

The role map is plain SQL that Spark and the oracle both read; operators only
see the civic tables: people, meetings, motions, votes and so on.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

_DAY = "year({d}) * 10000 + month({d}) * 100 + day({d})"
_ODAY = _DAY.format(d="o_orderdate")

#: In an order in which each may use those before. Shared dialect: runs on Spark and on DuckDB.
ROLES: dict[str, str] = {
    "councillors": "SELECT s_suppkey AS id, concat('Given', cast(s_suppkey % 17 AS string)) AS given_name, concat('Family', cast(s_suppkey % 60 AS string)) AS family_name, s_name AS slug FROM supplier",
    # The same persons as extractions spell them: with honorifics, swapped fields and placeholders.
    "roster": """SELECT id, CASE WHEN id % 5 = 0 THEN concat('Cr ', given_name) WHEN id % 7 = 0 THEN 'Unknown' WHEN id % 11 = 0 THEN family_name ELSE given_name END AS given_name,
        CASE WHEN id % 13 = 0 AND id % 5 <> 0 THEN 'Mayor' ELSE family_name END AS family_name FROM councillors""",
    "terms": """SELECT s_suppkey AS councillor_id, CASE WHEN s_suppkey % 10 = 0 THEN 'Mayor' ELSE 'Councillor' END AS role, cast('1995-06-01' AS date) AS term_start,
        CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE cast('1999-05-31' AS date) END AS term_end FROM supplier WHERE s_suppkey % 13 <> 5""",
    "meetings": f"""SELECT id, meeting_date, CASE id % 4 WHEN 0 THEN 'ordinary' WHEN 1 THEN 'special' WHEN 2 THEN 'committee' ELSE 'briefing' END AS meeting_type,
        CASE WHEN id % 9 = 0 THEN 'agenda' ELSE 'minutes' END AS document_type FROM (SELECT DISTINCT {_ODAY} AS id, cast(o_orderdate AS date) AS meeting_date FROM orders) x""",
    "votes": """SELECT l_orderkey * 1000000 + l_suppkey AS id, l_orderkey AS motion_id, l_suppkey AS councillor_id,
        CASE min(l_returnflag) WHEN 'N' THEN 'for' WHEN 'R' THEN 'against' ELSE 'absent' END AS choice, max(l_linestatus) = 'O' AS declared_interest FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "tallies": "SELECT motion_id, min(councillor_id) AS low, max(councillor_id) AS high, count(CASE WHEN choice = 'for' THEN 1 END) AS n_for, count(CASE WHEN choice = 'against' THEN 1 END) AS n_against, count(CASE WHEN choice = 'absent' THEN 1 END) AS n_absent FROM votes GROUP BY motion_id",
    "motions": f"""SELECT o_orderkey AS id, {_ODAY} AS meeting_id, cast(o_orderdate AS date) AS meeting_date, year(o_orderdate) AS year, cast(o_orderkey % 40 AS string) AS item_number,
        concat('Item ', o_orderpriority) AS title, high AS moved_by_id, CASE WHEN low = high THEN NULL ELSE low END AS seconded_by_id,
        CASE o_orderstatus WHEN 'F' THEN 'carried' WHEN 'O' THEN 'lost' ELSE 'deferred' END AS outcome,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE n_for + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END END AS votes_for,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE n_against END AS votes_against,
        concat(lower(substr(o_orderpriority, 3)), CASE WHEN o_orderkey % 3 = 0 THEN ', planning' ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN ', tender' ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN ', budget' ELSE '' END) AS tags
        FROM orders LEFT JOIN tallies ON motion_id = o_orderkey""",
    # Every motion on one side of its date: what the officers put on the agenda, or what the minutes record. Numbers occur on both sides.
    "items": "SELECT *, CASE WHEN (id - id % 40) % 80 = 0 THEN 'agenda' ELSE 'minutes' END AS side FROM motions",
    "attendance": """SELECT meeting_id, councillor_id, CASE WHEN (councillor_id + meeting_id) % 11 = 0 THEN 'apology' ELSE 'present' END AS status
        FROM (SELECT DISTINCT m.meeting_id, v.councillor_id FROM votes v JOIN motions m ON m.id = v.motion_id) x WHERE (councillor_id + meeting_id) % 17 <> 0""",
    "applications": """SELECT o_orderkey AS id, o_orderkey AS motion_id, o_custkey % 500 AS site_id, c_name AS applicant_name, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'refused' ELSE 'deferred' END AS status,
        o_totalprice AS estimated_value, cast(o_orderdate AS date) AS application_date, year(o_orderdate) AS year FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0""",
    "submissions": """SELECT l_orderkey AS application_id, l_suppkey AS submitter, CASE l_returnflag WHEN 'R' THEN 'object' WHEN 'A' THEN 'support' ELSE 'neutral' END AS position,
        CASE WHEN cast(l_quantity AS int) % 4 = 0 THEN NULL ELSE cast(l_quantity AS int) % 4 END AS n FROM lineitem""",
    "declarations": f"""SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, {_ODAY} AS meeting_id, l_suppkey AS councillor_id,
        CASE l_linenumber % 4 WHEN 0 THEN 'financial' WHEN 1 THEN 'impartiality' WHEN 2 THEN 'proximity' ELSE 'other' END AS interest_type,
        CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 19 = 0 THEN 'X1' ELSE cast(l_orderkey % 40 AS string) END AS item_reference,
        CASE WHEN l_partkey % 5 = 0 THEN 'left the meeting' WHEN l_partkey % 7 = 0 THEN 'approval under 5.69' ELSE 'stayed' END AS description FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'""",
    "tenders": f"""SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, {_ODAY} AS meeting_id, year(o_orderdate) AS year, month(o_orderdate) AS month, concat('RFT-', cast(l_partkey % 700 AS string)) AS reference_number,
        CASE WHEN l_partkey % 23 = 0 THEN concat(CASE WHEN l_linenumber % 2 = 0 THEN 'Respondent ' ELSE 'Tenderer-' END, cast(l_linenumber AS string)) WHEN l_linenumber % 3 = 0 THEN concat('Works ', substr(s_name, 10), ' Pty Ltd') WHEN l_linenumber % 3 = 1 THEN concat('WORKS ', substr(s_name, 10)) ELSE concat('Works ', substr(s_name, 10), ' P/L') END AS awarded_to,
        CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice * 4 END AS amount, l_discount >= 0.08 AS is_confidential, l_suppkey AS firm_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 45""",
    "appointments": f"""SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, {_ODAY} AS meeting_id, cast(o_orderdate AS date) AS meeting_date, l_suppkey AS councillor_id,
        CASE WHEN l_partkey % 2 = 0 THEN 'member' ELSE 'deputy' END AS role, concat('Body ', cast(l_partkey % 5 AS string)) AS body_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND l_quantity > 46""",
    "budget_items": f"""SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, {_ODAY} AS meeting_id, year(o_orderdate) AS year, concat('Part ', cast(l_partkey AS string)) AS description,
        CASE WHEN l_tax < 0.015 THEN NULL ELSE l_extendedprice END AS amount, l_discount < 0.015 AS is_confidential FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity < 4""",
    "other_items": f"""SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, {_ODAY} AS meeting_id, year(o_orderdate) AS year,
        CASE l_partkey % 7 WHEN 0 THEN 'Confidential Report - Nil' WHEN 1 THEN 'Land sale and lease' WHEN 2 THEN 'Legal advice' WHEN 3 THEN 'Staff contract' WHEN 4 THEN 'Tender award' WHEN 5 THEN 'Development application' ELSE 'General business' END AS description,
        l_discount > 0.055 AS is_confidential FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity BETWEEN 10 AND 14""",
    "deputations": "SELECT event_id AS id, 19950101 + (event_id % 7) * 10000 + (event_id % 12) * 100 + event_id % 28 AS meeting_id FROM events WHERE event_type = 'click'",
    "petitions": "SELECT event_id AS id, 19950101 + (event_id % 7) * 10000 + (event_id % 12) * 100 + event_id % 28 AS meeting_id, event_id % 300 AS signatory_count FROM events WHERE event_type = 'signup'",
    # What an extraction quotes of each document: a verbatim piece, one whose spaces are lost, a passage of its own, and every third time nothing.
    "quotes": """SELECT doc_id, 1 AS quote_id, substr(text, 11, 120) AS quote FROM documents UNION ALL SELECT doc_id, 2, replace(substr(text, 61, 90), ' ', '') FROM documents
        UNION ALL SELECT d.doc_id, 3, b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 UNION ALL SELECT doc_id, 4, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE substr(text, 200, 300) END FROM documents""",
    "questions": """SELECT q.conv_id * 100 + q.turn AS id, 19950101 + (q.conv_id % 7) * 10000 + (q.conv_id % 12) * 100 + q.conv_id % 28 AS meeting_id, 1995 + q.conv_id % 7 AS year, q.text AS question,
        CASE WHEN q.turn % 4 = 2 THEN CASE WHEN q.conv_id % 3 = 0 THEN 'A response will be provided in writing.' WHEN q.conv_id % 3 = 1 THEN 'Not answered at the meeting' ELSE 'Taken on notice.' END ELSE a.text END AS response FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""",
}


def civic(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """All civic tables as lazy frames, beside the driver's own; nothing is read until a query does."""
    made: dict[str, DataFrame] = {}

    class Tables(SimpleNamespace):
        def __getattr__(self, name: str) -> DataFrame:
            if name not in made:
                if name in ROLES:
                    text = ROLES[name]
                    used = {n: getattr(self, n) for n in (*BASE, *ROLES) if n != name and _names(text, n)}
                    for n in used:
                        text = _quoted(text, n)
                    made[name] = spark.sql(text, **used)
                elif name in BASE:
                    made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                else:
                    raise AttributeError(name)
            return made[name]

    return Tables()


def _names(text: str, table: str) -> bool:
    import re

    return re.search(rf"\b(?:FROM|JOIN)\s+{table}\b", text) is not None


def _quoted(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}}", text)


def oracle(sql: str) -> str:
    """The query with the civic tables that it names, as common table expressions."""
    need: list[str] = []

    def want(text: str) -> None:
        for n in ROLES:
            if n not in need and _names(text, n):
                want(ROLES[n])
                if n not in need:
                    need.append(n)

    want(sql)
    body = sql.strip()
    ctes = [f"{n} AS ({ROLES[n]})" for n in need]
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}" if ctes else body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}" if ctes else body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
