"""Inputs derived from the given tables. Each text runs unchanged in Spark and in the oracle."""

from .base import INPUTS

# Law texts: an order is a text arriving for the law of its customer.
INPUTS["law_facts"] = """
SELECT o_orderkey AS arrival, CAST(o_custkey AS STRING) AS law, CAST(o_orderdate AS DATE) AS effective_from,
  CAST(o_custkey % 40 + 1 AS STRING) AS a, CAST(41 + o_orderkey % 4 AS STRING) AS b,
  CAST(o_custkey % 12 + 1 AS STRING) AS m, o_orderstatus AS st
FROM {orders}
"""
INPUTS["law_lines"] = """
SELECT arrival, law, effective_from, a, b, m, st,
  concat('Status ', st, ' duty under Article ', b, ' of Law ', law, '; see Κεφ. ', a, ', Ν. ', a, '(I)/1999.') AS l_body,
  concat('(1)First duty of Article ', b, '(2)(α) and ECLI:CY:AD:1999:A', a, '.') AS l_para,
  concat('(2) second party shall pay €', a, ',000.50 by 12/', m, '/1999 in case ', a, '/1999') AS l_loose,
  concat('Ρύθμιση ', st, ' see Article ', a, ' and article ', b) AS l_last
FROM {law_facts}
"""
INPUTS["law_source"] = """
SELECT arrival, law, effective_from, concat('Law of customer ', law) AS title, 'CY' AS jurisdiction,
  concat('Law ', law, ' preamble', chr(10), 'Article ', a, chr(10), l_body, chr(10), l_para, chr(10), l_loose, chr(10),
         'Άρθρο ', b, '.', chr(10), l_last, chr(10)) AS raw_text
FROM {law_lines}
"""

# Judgments: a conversation is a judgment, a turn a piece of its text under the heading of its role.
INPUTS["judgment_pieces"] = """
SELECT concat('case-', CAST(conv_id AS STRING)) AS case_id, turn,
  concat(CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN ''
              WHEN role = 'system' THEN concat('Order:', chr(10))
              WHEN role = 'user' AND turn % 3 = 0 THEN concat('The Facts', chr(10))
              WHEN role = 'user' THEN concat('Procedural history:', chr(10))
              WHEN turn % 4 = 1 THEN concat('Legal analysis', chr(10))
              ELSE concat('HOLDING.', chr(10)) END,
         text, chr(10), 'See ECLI:CY:AD:2019:A', CAST(conv_id % 97 AS STRING), ' and Article ',
         CAST(conv_id % 40 + 1 AS STRING), ' awarding damages and costs.') AS text
FROM {conversations}
"""
INPUTS["judgments"] = """
SELECT concat('case-', CAST(conv_id AS STRING)) AS case_id, conv_id,
  concat('Customer v State ', CAST(conv_id AS STRING)) AS title, 'CY' AS jurisdiction,
  concat('NATION_', CAST(conv_id % 25 AS STRING)) AS court, concat(CAST(conv_id AS STRING), '/2019') AS case_number,
  concat('ECLI:CY:AD:2019:A', CAST(conv_id AS STRING)) AS ecli,
  concat('version-', CAST(conv_id AS STRING)) AS version_id, CAST(conv_id % 40 AS STRING) AS applicable_law
FROM {conversations} GROUP BY conv_id
"""
