"""Questions about this package's own sources, written by hand, with the files that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import QUESTION

#: (question, category, difficulty, expected answer, gold files)
QUESTIONS = (
    ("Where are the postings of the inverted index built?", "code_lookup", "single_hop", "bm25.build tokenises once and packs the postings into blocks with their maxima.", ["tessera/operators/bm25.py"]),
    ("Which function splits an identifier into its camel and snake parts?", "code_lookup", "single_hop", "subtokens in the text functions.", ["tessera/functions/text.py"]),
    ("How does a hit get from the sources to a fused rank?", "architecture", "multi_hop", "The knowledge base asks each source, fusion tags, fuses and ranks the hits.", ["tessera/plans/knowledge.py", "tessera/operators/fusion.py"]),
    ("What happens between a question and its checked citations?", "architecture", "multi_hop", "The engine searches, packs evidence, asks a model and checks what it cites.", ["tessera/engine.py", "tessera/operators/context.py", "tessera/operators/generation.py"]),
    ("Which setting bounds the tokens of the evidence?", "configuration", "single_hop", "context.budget.", ["tessera/config.py"]),
    ("Which file patterns does ingestion include by default?", "configuration", "single_hop", "The include list of the ingestion settings.", ["tessera/config.py"]),
    ("What tests cover packing under a budget?", "tests", "single_hop", "The operator tests pack evidence with overlaps, caps and budgets.", ["tests/test_operators.py"]),
    ("Who calls the function that drops repeated chunk ids?", "change_impact", "multi_hop", "Ingestion and the catalogue's dedup query.", ["tessera/plans/schema.py", "tessera/plans/knowledge.py", "tessera/catalog.py"]),
    ("What fails when a model can't be reached?", "debugging", "single_hop", "The call leaves a null text; the retrying model asks again before.", ["tessera/operators/generation.py"]),
    ("Why does loading a knowledge base raise FileNotFoundError?", "debugging", "single_hop", "The folder has no version with chunks.", ["tessera/plans/knowledge.py"]),
    ("What does the README say about the shared folder?", "documentation", "single_hop", "spark.checkpoint.dir names the folder that all executors share.", ["README.md"]),
    ("How are commits read without keeping the whole history in memory?", "architecture", "single_hop", "A data source streams the log and parses it record by record.", ["tessera/sources/git.py"]),
)


def curated(spark: SparkSession) -> DataFrame:
    """The questions above, as rows of QUESTION; their source is curated."""
    rows = [(f"curated-{i:02}", q, category, hop, answer, files, [], [], [], "curated", "test", {"by": "hand"}, True) for i, (q, category, hop, answer, files) in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, QUESTION)


def answerable(questions: DataFrame, paths: DataFrame) -> DataFrame:
    """The questions whose gold files are all among paths (path)."""
    each = questions.select("id", F.explode("relevant_files").alias("path"))
    lacking = each.join(paths.select("path").distinct(), "path", "left_anti").select("id").distinct()
    return questions.join(lacking, "id", "left_anti")
