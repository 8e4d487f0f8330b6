"""What the entry module adds when this subpackage is there."""

import corpus_pipeline
from cratework.llm.oracles import ORACLES
from cratework.llm.queries import QUERIES

LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
LLM_ORACLES = dict(ORACLES)
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
