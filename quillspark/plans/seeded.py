"""A corpus in which every signal fires: documents with phrases added by number, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is added to documents by doc_id modulo the number of seeds.
SEEDS = [
    "",
    "It is important to note that the road was long. However, the many aspects of the system stay. Moreover, we wait.",
    "This is a very really important thing. It was truly quite impactful. We saw several things.",
    "She started to walk home. He began to speak at once. They went on.",
    "At the end of the day it was as if nothing moved. A sense of calm before the storm stayed. It was as if the kind of day ended.",
    "The door — the old one — closed. He waited--then left. It ended here —",
    "The cat sat down here. The dog ran off there. The bird flew up high. A fox.",
    "We are here now. We are here again today and all week long. We are here for the last time, perhaps. So it goes",
    "The committee met in the old hall by the river and spoke for hours about the plan, and the members who had come from the far towns asked many questions that nobody in the room could answer with any certainty at all.",
    "The letter was written by hand. The house had been quickly painted. The song is often forgotten by most people.",
    'Dr. Smith met J. R. Jones at 3.5 p.m. in the U.S. yesterday... Then he left. See e.g. Figure 2. "Was it so?" he asked. (It was.) No',
    "Don't you see? It's fine! I can't say; we aren't sure. I do not know, it is late, and they are gone. You’re right.",
    "\n\n# A heading\n\nFirst line of prose here. It is very really important.\n\n- a bullet\n1. a number\n> a quote\n| a | table |\n\n```\ncode — here\n\nmore code\n```\n\nLast words. It goes on — and on.",
    "In today's fast-paced world, this serves as a testament to the journey. It is not just a tapestry, but a landscape. I hope this helps! Experts say it could potentially vary.",
    "The family likely walked slowly home. Only the early train had truly gone really far. It was was late late.",
    "The same words again. Another line stands between them now. The same words again. The same words again.",
]

#: What rewriting queries add to those, by doc_id modulo their number.
EDITS = [
    "We are here now. We are there. we are home. They wait. It was as if the road slept. He felt a wave of anger.",
    "She was standing by the door, and i was looking up. The house that made it was the kind of house that held. And it knew that, was so.",
    "Here is a revised version: Great question! Let me know if you'd like more. As an AI, it can often seem so. In conclusion, it seems that we delve into the landscape of things.",
    "The **old** town — breathtaking , vibrant — is nestled within hills. It is a testament to a pivotal moment. On the one hand, it is very good. Ultimately, this underscores the need for rest.",
    "The hall was dark, the hall was cold, and The Hall was empty! Mara was tired, mara was late, and Mara was -alone-. The cat was old, the dog was old, and the cat was gone.",
    "There are very many rooms, however; it can often seem so. It is important to note that this can be seen as a start — or, in order to rest, a stop. I am not sure. They do not know, and he cannot say.",
    "No one came. They saw it. They saw him. They saw us all. They saw me too. They saw it then. They saw nothing new. They saw it again. They felt fear , , and waited.",
]


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out over the session's cores if its files are fewer; a table of many files stays where it is.

    Analysing a text costs far more than moving it once, and one file of one row group is one task otherwise.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, n_chars, sequence_no; a batch is a source."""
    d = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    seed = F.element_at(F.array(*map(F.lit, SEEDS)), (F.col("doc_id") % len(SEEDS) + 1).cast("int"))
    return d.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), seed))


def sql() -> str:
    """The same as documents(), over the table of that name."""
    cases = " ".join(f"WHEN {i} THEN '" + s.replace("'", "''") + "'" for i, s in enumerate(SEEDS))
    return f"SELECT doc_id, coalesce(text, '') || ' ' || CASE doc_id % {len(SEEDS)} {cases} END AS text, lang, source, n_chars FROM documents"


def with_edits(df: DataFrame) -> DataFrame:
    edit = F.element_at(F.array(*map(F.lit, EDITS)), (F.col("doc_id") % len(EDITS) + 1).cast("int"))
    return df.withColumn("text", F.concat("text", F.lit(" "), edit))


def edits_sql() -> str:
    """The same as with_edits() of documents()."""
    cases = " ".join(f"WHEN {i} THEN '" + s.replace("'", "''") + "'" for i, s in enumerate(EDITS))
    return f"SELECT * REPLACE (text || ' ' || CASE doc_id % {len(EDITS)} {cases} END AS text) FROM ({sql()})"
