"""All queries of the library and, where SQL can express them, their SQL."""

from __future__ import annotations

from textwarden.plans import decision_queries, language_queries, match_queries, monitor_queries, policy_queries, stream_queries, text_queries

MODULES = (text_queries, match_queries, decision_queries, policy_queries, monitor_queries, stream_queries, language_queries)
QUERIES = {name: q for m in MODULES for name, (q, _) in m.Q.items()}
ORACLES = {name: sql for m in MODULES for name, (_, sql) in m.Q.items() if sql}
FLAGSHIP = "h22_moderate_corpus"
