"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bitslice import op4_topk
from .decontaminate import op7_decontaminate
from .embdedup import op13_embdedup
from .filteraudit import op12_filters
from .fim import op11_fim
from .linedup import op5_linedup
from .minhash import op8_minhash
from .mixing import op10_mix
from .oracles import ORACLES
from .secrets import op1_secrets
from .sharding import op3_shard
from .suffix import op9_suffix
from .tokens import op2_tokens
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_secrets, op2_tokens, op3_shard, op4_topk, op5_linedup, op6_toxicity, op7_decontaminate, op8_minhash, op9_suffix, op10_mix, op11_fim, op12_filters, op13_embdedup)}

__all__ = ["ORACLES", "QUERIES"]
