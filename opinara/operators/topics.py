"""PLSA and robust PLSA by expectation maximisation over DataFrames.

In one job a round passes over the bag of words twice, for the expected counts
by document and by word.  Each row meets the mixture of its document and the
probabilities of its word, which both passes get from one broadcast.  The bag and
the document table share their bucketing and the word table is joined by
``join_words``, so the bag itself does not move: only partial sums by word and the
rare words beyond the broadcast limit are shuffled.  The sums by word are written
beside the old probabilities and read as the new ones.  The tables hold one
column per topic (``t0..`` by document, ``p0..`` by word), which keeps the
sums in generated code.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.numeric import add, ratio_or
from opinara.functions.text import hash_unit
from opinara.operators.corpus import Corpus, Vocabulary, build_corpus, join_words
from opinara.operators.priors import Prior, UniformPrior
from opinara.sources.state import Stored, store, store_bucketed, together

MINUS_INFINITY = float("-inf")


def _row_bytes(topics: int) -> int:
    return 8 * (topics + 2)


def initial_phi(vocabulary: Vocabulary, topics: int, seed: int = 0) -> DataFrame:
    """(word_id, p0..): random word probabilities, a pure function of token, topic and seed."""
    raw = vocabulary.frame.select(
        "word_id",
        *[hash_unit(F.concat(F.col("token"), F.lit(f":{k}:{seed}"))).alias(f"c{k}") for k in range(topics)],
    )
    totals = raw.agg(*[F.sum(f"c{k}") for k in range(topics)]).first()
    return raw.select("word_id", *[(F.col(f"c{k}") / F.lit(totals[k])).alias(f"p{k}") for k in range(topics)])


@dataclass
class FoldIn:
    """Topic mixtures of a document set: theta(doc_id, t0..) and one perplexity per round."""

    theta: DataFrame
    perplexities: list[float]
    noise_of: Callable[[], DataFrame] | None = None
    background: DataFrame | None = None
    owned: list[Stored] = field(default_factory=list)

    @property
    def noise(self) -> DataFrame | None:
        """(doc_id, token, noise) of the robust kind; who asks for it may have it written."""
        return self.noise_of() if self.noise_of else None

    @property
    def perplexity(self) -> DataFrame:
        """(iteration, perplexity), from before the first round to after the last."""
        rows = list(enumerate(self.perplexities))
        return self.theta.sparkSession.createDataFrame(rows, "iteration int, perplexity double")


# The largest exponent whose exponential is finite.
_LARGEST_EXPONENT = math.log(sys.float_info.max)


@dataclass
class TopicModel(FoldIn):
    """A fitted model: theta, phi(token, p0..), and for the robust kind background and noise."""

    phi: DataFrame = None
    trainer: "Plsa" = None
    vocabulary: Vocabulary = None
    word_phi: DataFrame = None
    word_background: DataFrame | None = None
    last_run: object = None
    broadcast_bytes: int | None = None

    def transform(self, docs: DataFrame, background: str = "reestimate") -> FoldIn:
        """Topic mixtures of new (doc_id, text) rows under the fitted phi."""
        corpus = build_corpus(docs, vocabulary=self.vocabulary, broadcast_bytes=self.broadcast_bytes)
        result = self.fold_in(corpus, background)
        if self.trainer.iterations:  # without a round the result is a view of the corpus
            corpus.drop()
        return result

    def fold_in(self, corpus: Corpus, background: str = "reestimate") -> FoldIn:
        """Mixtures of a corpus that was built with this model's vocabulary; any other numbers its words differently."""
        if self.vocabulary is not None and corpus.vocabulary is not self.vocabulary:
            raise ValueError("build the corpus with vocabulary=model.vocabulary")
        return self.trainer.fold_in(corpus, self, background)

    def log_likelihood(self, corpus: Corpus) -> DataFrame:
        """(doc_id, loglik) of the documents the model was fitted to, the prior of theta included."""
        return self.trainer.log_likelihood(corpus, self)

    def drop(self) -> None:
        """Delete the model's tables."""
        for table in self.owned:
            table.drop()
        self.owned = []


class Plsa:
    """Probabilistic latent semantic analysis with a fixed number of rounds."""

    def __init__(
        self,
        topics: int = 5,
        iterations: int = 10,
        seed: int = 0,
        theta_prior: Prior | None = None,
        phi_prior: Prior | None = None,
        perplexity: bool = True,
    ):
        self.topics = topics
        self.iterations = iterations
        self.seed = seed
        self.theta_prior = theta_prior or UniformPrior()
        self.phi_prior = phi_prior or UniformPrior()
        self.perplexity = perplexity

    # -- public API -------------------------------------------------------

    def fit(self, corpus: Corpus, phi: DataFrame | None = None) -> TopicModel:
        """Fit theta and phi; ``phi`` (word_id, p0..) replaces the random start."""
        if phi is None:
            phi = initial_phi(corpus.vocabulary, self.topics, self.seed)
        run = self._start(corpus, store(phi, "phi"))
        run.go(frozen=False)
        return self._model(run)

    def fold_in(self, corpus: Corpus, model: TopicModel, background: str = "reestimate") -> FoldIn:
        """Fit theta only, phi stays as fitted."""
        run = self._start(corpus, model.word_phi)
        run.go(frozen=True)
        return FoldIn(run.theta.select("doc_id", *run.ts()), run.perplexities, owned=run.kept())

    def log_likelihood(self, corpus: Corpus, model: TopicModel) -> DataFrame:
        run = self._start(corpus, model.word_phi)
        run.theta = model.theta
        return run.document_likelihoods()

    # -- parts the robust model replaces -----------------------------------

    def _start(self, corpus: Corpus, phi: Stored | DataFrame) -> "_Run":
        return _Run(self, corpus, phi)

    def _model(self, run: "_Run") -> TopicModel:
        words = run.corpus.vocabulary.frame.select("word_id", "token")
        return TopicModel(
            theta=run.theta.select("doc_id", *run.ts()),
            perplexities=run.perplexities,
            owned=run.kept(),
            phi=run.phi.join(words, "word_id").drop("word_id"),
            trainer=self,
            vocabulary=run.corpus.vocabulary,
            word_phi=run.phi,
            broadcast_bytes=run.corpus.broadcast_bytes,
        )


class _Run:
    """The rounds of one fit: current theta and phi, and the tables that hold them."""

    def __init__(self, trainer: Plsa, corpus: Corpus, phi: Stored | DataFrame):
        self.trainer = trainer
        self.corpus = corpus
        self.ks = range(trainer.topics)
        self.head = corpus.vocabulary.head(_row_bytes(trainer.topics), corpus.broadcast_bytes)
        self.phi_table = phi if isinstance(phi, Stored) else None
        self.phi = phi.frame if isinstance(phi, Stored) else phi
        self.theta_table: Stored | None = None
        self.theta = corpus.documents.select(
            "doc_id", *[F.lit(1.0 / trainer.topics).alias(f"t{k}") for k in self.ks]
        )
        self.bag = corpus.bow
        self.perplexities: list[float] = []

    def kept(self) -> list[Stored]:
        return [table for table in (self.theta_table, self.phi_table) if table]

    # -- columns -----------------------------------------------------------

    def ps(self) -> list[Column]:
        return [F.col(f"p{k}") for k in self.ks]

    def ts(self) -> list[Column]:
        return [F.col(f"t{k}") for k in self.ks]

    def mixture(self) -> Column:
        return add([p * t for p, t in zip(self.ps(), self.ts())])

    # -- one round -----------------------------------------------------------

    def rows(self, buckets: int | None = None) -> DataFrame:
        """The bag of words with theta, phi and ``z``, the probability of the word in the document; see ``join_words``."""
        # Of few new documents the words are few, however many the model has.
        words = self.corpus.words
        phi = self.phi if words is None else self.phi.join(words, "word_id", "left_semi")
        joined = join_words(self.bag, phi, self.head, self.corpus.vocabulary.size, buckets, self.theta)
        return joined.withColumn("z", self.mixture())

    @staticmethod
    def share() -> Column:
        """n / z; NULL, hence no contribution to any sum, where z is zero."""
        return F.when(F.col("z") > 0, F.col("n") / F.col("z"))

    @staticmethod
    def log_likelihood() -> Column:
        return F.when(F.col("z") > 0, F.col("n") * F.ln("z")).otherwise(F.lit(MINUS_INFINITY))

    def expected(self) -> dict[str, Column]:
        """The expected counts of a row's word per topic."""
        return {f"r{k}": F.col("share") * p * t for k, (p, t) in enumerate(zip(self.ps(), self.ts()))}

    def document_sums(self) -> dict[str, Column]:
        """What a row adds to the sums of its document."""
        return {**self.expected(), "ll": self.log_likelihood()}

    def word_sums(self, frozen: bool) -> dict[str, Column]:
        """What a row adds to the sums of its word."""
        return self.expected()

    def go(self, frozen: bool) -> None:
        for _ in range(self.trainer.iterations):
            self.begin_round()
            prior = self.log_priors()
            sums = self.store_sums(frozen) if self.needs_words(frozen) else None
            jobs = [lambda: self.round_theta(sums)]
            if sums:
                jobs.append(lambda: self.round_phi(sums, frozen))
            done = together(self.theta.sparkSession, *jobs)
            theta, likelihood = done[0]
            if self.trainer.perplexity:
                self.note_perplexity(likelihood, prior)
            self.advance(theta, sums, done[1] if sums else None)
        if self.trainer.perplexity:
            self.begin_last_pass()
            likelihood = self.rows().agg(F.sum(self.log_likelihood())).first()[0]
            self.note_perplexity(likelihood, self.log_priors())

    def round_theta(self, sums: Stored | None) -> tuple[Stored, float | None]:
        by_document = sums.frame.where("kind = 'document'").select("doc_id", *self.document_sums()) if sums else None
        theta = self.store_theta(self.sums_by_document() if by_document is None else by_document)
        return theta, theta.frame.agg(F.sum("ll")).first()[0] if self.trainer.perplexity else None

    def round_phi(self, sums: Stored, frozen: bool) -> DataFrame:
        return self.new_phi(self.counted(sums.frame.where("kind = 'word'"), frozen), frozen)

    def begin_round(self) -> None:
        """What a round needs before it passes over the bag."""

    def begin_last_pass(self) -> None:
        """The same before the pass over the bag that follows the last round."""

    def needs_words(self, frozen: bool) -> bool:
        return not frozen

    def store_sums(self, frozen: bool) -> Stored:
        """The sums by document, and those by word beside the old phi, in one job that broadcasts phi once.

        Every word of the vocabulary stays.
        """
        sums = self.summed("word_id", self.word_sums(frozen))
        by_word = self.phi.select("word_id", *self.ps()).join(sums, "word_id", "left").withColumn("kind", F.lit("word"))
        by_document = self.sums_by_document().withColumn("kind", F.lit("document"))
        return store(by_document.unionByName(by_word, allowMissingColumns=True), "sums", "kind")

    def sums_by_document(self) -> DataFrame:
        """Follows the bucketing, without a shuffle."""
        return self.summed("doc_id", self.document_sums())

    def summed(self, key: str, sums: dict[str, Column]) -> DataFrame:
        rows = self.rows().withColumn("share", self.share()).select(key, *[column.alias(name) for name, column in sums.items()])
        return rows.groupBy(key).agg(*[F.sum(name).alias(name) for name in sums])

    def store_theta(self, sums: DataFrame) -> Stored:
        """Regularise and normalise; documents without words or counts keep their mixture."""
        joined = self.theta.join(sums.hint("shuffle_hash"), "doc_id", "left")
        counts = {f"c{k}": c for k, c in enumerate(self.regularised(self.trainer.theta_prior, self.ts(), joined))}
        counted = joined.withColumns(counts).withColumn("total", add([F.col(c) for c in counts]))
        new = counted.select(
            "doc_id",
            "ll",
            *[ratio_or(F.col(f"c{k}"), F.col("total"), t).alias(f"t{k}") for k, t in enumerate(self.ts())],
            *self.theta_extra(),
        )
        return store_bucketed(new, "theta", "doc_id", self.corpus.buckets)

    def theta_extra(self) -> list[Column]:
        return []

    def counted(self, words: DataFrame, frozen: bool) -> DataFrame:
        """Regularised counts ``c`` beside the old ``p``."""
        return words.select("word_id", *self.ps(), *self.counts(words))

    def counts(self, joined: DataFrame) -> list[Column]:
        """Regularised counts by word; words without any count take part with zero."""
        return [c.alias(f"c{k}") for k, c in enumerate(self.regularised(self.trainer.phi_prior, self.ps(), joined))]

    def regularised(self, prior: Prior, olds: list[Column], joined: DataFrame) -> list[Column]:
        counts = [F.coalesce(f"r{k}", F.lit(0.0)) for k in self.ks]
        return prior.regularize_matrix(counts, olds, self.matrix_sums(prior, counts, olds, joined))

    @staticmethod
    def matrix_sums(prior: Prior, counts: list[Column], olds: list[Column], rows: DataFrame) -> dict[str, float]:
        """What a prior needs to know of the whole matrix: a few numbers, by one aggregation over its rows."""
        sums = prior.matrix_sums(counts, olds)
        if not sums:
            return {}
        found = rows.agg(*[column.alias(name) for name, column in sums.items()]).first()
        return {name: found[name] if found[name] is not None else 0.0 for name in sums}

    def normalised(self, counts: DataFrame, *others: Column) -> DataFrame:
        """Divide by the topic totals; a topic without any count keeps its words."""
        totals = counts.agg(*[F.sum(f"c{k}") for k in self.ks]).first()
        columns = [
            (F.col(f"c{k}") / F.lit(totals[k]) if (totals[k] or 0) > 0 else F.col(f"p{k}")).alias(f"p{k}")
            for k in self.ks
        ]
        return counts.select("word_id", *columns, *others)

    def new_phi(self, table: DataFrame, frozen: bool) -> DataFrame:
        return self.normalised(table)

    def advance(self, theta: Stored, sums: Stored | None, phi: DataFrame | None) -> None:
        """Move on to the new tables; ``phi`` reads the sums by word."""
        old = [self.theta_table, self.phi_table if sums else None]
        self.theta_table = theta
        self.theta = theta.frame.drop("ll")
        if sums:
            self.phi_table, self.phi = sums, phi
        self.leave([table for table in old if table])

    def leave(self, tables: list[Stored]) -> None:
        """Delete the old tables, which nothing reads any more."""
        for table in tables:
            table.drop()

    # -- perplexity ------------------------------------------------------------

    def document_likelihoods(self) -> DataFrame:
        sums = self.rows().groupBy("doc_id").agg(F.sum(self.log_likelihood()).alias("ll"))
        joined = self.theta.join(sums.hint("shuffle_hash"), "doc_id", "left")
        prior = self.trainer.theta_prior.log_prior(self.ts())
        return joined.select("doc_id", (F.coalesce("ll", F.lit(0.0)) + prior).alias("loglik"))

    def log_priors(self) -> float:
        """Log density of the current theta and phi."""
        total = 0.0
        if not self.trainer.perplexity:
            return total
        prior = self.trainer.theta_prior
        if not prior.flat:
            total += self.theta.agg(F.sum(prior.log_prior(self.ts()))).first()[0] or 0.0
            total += prior.matrix_log(self.matrix_sums(prior, self.ts(), self.ts(), self.theta))
        prior = self.trainer.phi_prior
        if not prior.flat and self.corpus.vocabulary.size:
            terms = self.phi.agg(F.sum(add([prior.log_term(p) for p in self.ps()]))).first()[0]
            total += terms + self.trainer.topics * prior.log_constant(self.corpus.vocabulary.size)
            total += prior.matrix_log(self.matrix_sums(prior, self.ps(), self.ps(), self.phi))
        return total

    def note_perplexity(self, likelihood: float | None, prior: float) -> None:
        if self.corpus.length:
            exponent = -((likelihood or 0.0) + prior) / self.corpus.length
            self.perplexities.append(math.exp(exponent) if exponent <= _LARGEST_EXPONENT else math.inf)
