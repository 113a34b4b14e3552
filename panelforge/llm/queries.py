"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.avi import op3_avi
from panelforge.llm.bpe import op8_bpe
from panelforge.llm.licenses import op4_license
from panelforge.llm.linededup import OP9_SQL, op9_line_dedup
from panelforge.llm.mixing import OP1_SQL, op1_mixture
from panelforge.llm.neighbours import OP7_SQL, op7_neighbours
from panelforge.llm.quality import op6_quality
from panelforge.llm.secrets import op5_secrets
from panelforge.llm.sharding import op2_shards
from panelforge.llm.simhash import op10_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_mixture, op2_shards, op3_avi, op4_license, op5_secrets, op6_quality, op7_neighbours, op8_bpe, op9_line_dedup, op10_simhash]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixture": OP1_SQL, "op7_neighbours": OP7_SQL, "op9_line_dedup": OP9_SQL}
