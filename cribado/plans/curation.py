"""End-to-end compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.functions.fixed import GENERATION_BATCH
from cribado.functions.text import render_prompt
from cribado.operators.generate import PredictorFactory, generate
from cribado.operators.head import DEFAULT_GRID, Candidate, Selection, select_head
from cribado.operators.labels import normalize_labels, parse_labels, tag_counts, top_tags
from cribado.operators.ledger import generate_with_ledger
from cribado.operators.ratings import clean_ratings, parse_ratings, training_rows
from cribado.operators.scoring import score_documents
from cribado.operators.selection import keep_by_score
from cribado.operators.split import TEST, TRAIN, stratified_split
from cribado.session import materialize

Encode = Callable[[DataFrame], DataFrame]


def ask(
    docs: DataFrame,
    text_col: str,
    template: str,
    factory: PredictorFactory,
    num_partitions: int | None = None,
    keep: Sequence[str] | None = None,
    output: str | None = None,
    batch_size: int = GENERATION_BATCH,
) -> DataFrame:
    """Render the prompts, ask the model, store rows with `response` and `error`.

    Only the columns `keep` (by default all but the text) are stored with the answers. The prompts are
    dealt out over `num_partitions` tasks, by default as many as the cluster has cores, however few
    the rows came in. With `output` a ledger of the answered batches is kept there, and a repeated or resumed call asks
    only for what it does not have (`ledger.generate_with_ledger`).
    """
    spark = docs.sparkSession
    kept = list(keep) if keep is not None else [c for c in docs.columns if c != text_col]
    tasks = num_partitions or spark.sparkContext.defaultParallelism
    prompts = docs.select(*kept, render_prompt(template, F.col(text_col)).alias("_prompt"))
    if output is None:
        answers = generate(prompts, "_prompt", factory, batch_size, tasks)
        return materialize(answers.select(*kept, "response", "error"))
    answers = generate_with_ledger(prompts, "_prompt", factory, output, kept, batch_size, tasks)
    return answers.select(*kept, "response", "error")


def train_on_responses(
    responses: DataFrame,
    id_col: str,
    feature_stages: Sequence[Estimator] = (),
    grid: Sequence[Candidate] = DEFAULT_GRID,
    encode: Encode | None = None,
    docs: DataFrame | None = None,
) -> Selection:
    """Parse and clean stored ratings, split them by class and select a head.

    Features come from `feature_stages` or from `encode`, which adds them to a DataFrame
    (`encoder_features`, `vector_features`). Responses are parsed once; the split reads only the stored
    ids and classes. `docs` has the texts if `responses` has none.
    """
    rated = training_rows(clean_ratings(parse_ratings(responses)))
    texts = docs if docs is not None else rated.drop("y", "label", "score_raw")
    keys = materialize(rated.select(id_col, "y", "label"))
    divided = stratified_split(keys, id_col).select(id_col, "y", "label", "split")
    rows = materialize(texts.join(divided, id_col))
    if encode:
        rows = encode(rows)
    train, test = (rows.filter(F.col("split") == name) for name in (TRAIN, TEST))
    return select_head(train, test, feature_stages, grid)


def score_corpus(
    docs: DataFrame, chosen: Selection, encode: Encode | None = None, num_partitions: int | None = None
) -> DataFrame:
    """All documents with `score` and `int_score`; `num_partitions` deals out few large files over more tasks."""
    rows = docs.repartition(num_partitions) if num_partitions else docs
    scored = score_documents(chosen.model, encode(rows) if encode else rows)
    return scored.select(*docs.columns, "score", "int_score")


def curate(
    docs: DataFrame,
    sample: DataFrame,
    id_col: str,
    text_col: str,
    template: str,
    factory: PredictorFactory,
    feature_stages: Sequence[Estimator] = (),
    threshold: int = 3,
    grid: Sequence[Candidate] = DEFAULT_GRID,
    encode: Encode | None = None,
    num_partitions: int | None = None,
    output: str | None = None,
) -> DataFrame:
    """Rate a sample, train a head on the ratings, score all documents, keep the good ones.

    `num_partitions` and `output` are those of `ask`.
    """
    rows = sample.select(id_col, text_col)
    responses = ask(rows, text_col, template, factory, num_partitions, [id_col], output)
    chosen = train_on_responses(responses, id_col, feature_stages, grid, encode, docs=rows)
    return keep_by_score(score_corpus(docs, chosen, encode), threshold)


def label_report(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    template: str,
    factory: PredictorFactory,
    num_partitions: int | None = None,
    output: str | None = None,
) -> DataFrame:
    """Label documents that carry a `dataset` column and report the top tags per dataset and combined."""
    rows = docs.select("dataset", id_col, text_col)
    answers = ask(rows, text_col, template, factory, num_partitions, ["dataset", id_col], output)
    labels = normalize_labels(parse_labels(answers))
    return top_tags(tag_counts(labels, id_col))
