"""All registered queries but those of the llm subpackage."""

from siltstone.plans import flows, grounds, similar, sites, web

FLAGSHIP = "a22_decision_gates"
QUERIES = {**web.QUERIES, **flows.QUERIES, **sites.QUERIES, **similar.QUERIES, **grounds.QUERIES}
SQL = {**web.SQL, **flows.SQL, **sites.SQL, **similar.SQL, **grounds.SQL}
