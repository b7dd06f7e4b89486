"""Queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from .chat import OP3_SQL, op3
from .decontaminate import OP2_SQL, op2
from .embedding_dedup import OP5_SQL, op5
from .language_id import op1
from .packing import op8
from .sharding import op7
from .simhash import op10
from .token_counts import op4
from .toxicity import op9
from .warc import OP6_SQL, op6


def queries() -> dict:
    return {"op1_language_id": op1, "op2_decontaminate": op2, "op3_chat_format": op3, "op4_token_counts": op4, "op5_embedding_dedup": op5, "op6_warc": op6, "op7_sharding": op7, "op8_packing": op8, "op9_toxicity": op9, "op10_simhash": op10}


def oracle_sql() -> dict:
    return {"op2_decontaminate": OP2_SQL, "op3_chat_format": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op6_warc": OP6_SQL}
