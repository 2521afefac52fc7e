"""Robust PLSA: besides the topics, a background over all words and noise per document explain words.

The noise of a word in a document changes every round.  It follows row by row
from the tables of the round before, so for a few rounds it is worked out where
the bag is read; then the bag is written anew with the word's unnormalised noise
``x``, in the same buckets.  The noise is ``x * s``, with ``s`` kept in the
document's row.

Noise that is not written reads the word tables of its rounds, each by a broadcast.
It is written before a pass or a result whose broadcasts would pass the limit together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.numeric import ratio_or
from opinara.operators.corpus import Corpus, join_words
from opinara.operators.priors import Prior
from opinara.operators.topics import FoldIn, Plsa, TopicModel, _row_bytes, _Run
from opinara.sources.state import Stored, store_bucketed

# Weights of background and noise.
GAMMA = 0.3
EPS = 0.01

# Rounds whose noise is worked out anew by each pass over the bag before another round writes it.
_UNWRITTEN_ROUNDS = 2


class RobustPlsa(Plsa):
    """PLSA with a background of weight ``gamma`` and noise of weight ``eps``."""

    def __init__(
        self,
        topics: int = 5,
        iterations: int = 10,
        seed: int = 0,
        theta_prior: Prior | None = None,
        phi_prior: Prior | None = None,
        perplexity: bool = True,
        gamma: float = GAMMA,
        eps: float = EPS,
    ):
        super().__init__(topics, iterations, seed, theta_prior, phi_prior, perplexity)
        self.gamma = float(gamma)
        self.eps = float(eps)

    def fold_in(self, corpus: Corpus, model: TopicModel, background: str = "reestimate") -> FoldIn:
        """Fit theta and noise of new documents under the fitted phi.

        ``background``: "reestimate" starts from a uniform background and fits
        it to the new documents; "fixed" keeps the model's.
        """
        if background not in ("reestimate", "fixed"):
            raise ValueError(f"unknown background mode: {background}")
        phi = model.word_phi
        if background == "fixed":
            phi = phi.join(model.word_background, "word_id")
        run = self._start(corpus, phi)
        run.fixed_background = background == "fixed"
        run.go(frozen=True)
        run.write_noise()
        return FoldIn(
            run.theta.select("doc_id", *run.ts()), run.perplexities, run.noise, run.background(), run.kept()
        )

    def _start(self, corpus: Corpus, phi: Stored | DataFrame) -> "_RobustRun":
        return _RobustRun(self, corpus, phi)

    def _model(self, run: "_RobustRun") -> TopicModel:
        model = super()._model(run)
        model.phi = model.phi.drop("bg")
        model.word_phi = run.phi.drop("bg")
        model.word_background = run.phi.select("word_id", "bg")
        model.background = run.background()
        model.noise_of = lambda: self._settled(model, names=True).noise()
        model.last_run = run
        return model

    @staticmethod
    def _settled(model: TopicModel, names: bool = False) -> "_RobustRun":
        """The run of the fit, its noise fit for a pass over the bag, or with ``names`` for one that only names the words."""
        run = model.last_run
        if run.unwritten and not run.fits(run.unwritten + (not names), names):
            model.owned.append(run.settle())
        return run

    def log_likelihood(self, corpus: Corpus, model: TopicModel) -> DataFrame:
        """With the noise and background of the last round, which belong to the corpus that was fitted to."""
        if model.last_run is None or model.last_run.corpus is not corpus:
            raise ValueError("noise is known for the corpus of the fit only")
        return self._settled(model).document_likelihoods()


class _RobustRun(_Run):
    def __init__(self, trainer: RobustPlsa, corpus: Corpus, phi: Stored | DataFrame):
        super().__init__(trainer, corpus, phi)
        size = corpus.vocabulary.size
        self.head = corpus.vocabulary.head(_row_bytes(trainer.topics + 1), corpus.broadcast_bytes)
        self.fixed_background = False
        if "bg" not in self.phi.columns:
            self.phi = self.phi.withColumn("bg", F.lit(1.0 / size if size else 0.0))
        length = F.col("length")
        self.theta = corpus.documents.select(
            "doc_id",
            *[F.lit(1.0 / trainer.topics).alias(f"t{k}") for k in self.ks],
            ratio_or(F.lit(1.0), length, F.lit(0.0)).alias("s"),
        )
        self.weights_table: Stored | None = None
        self.bag = corpus.bow.withColumn("x", F.lit(1.0))
        self.unwritten = 0
        # Tables of earlier rounds that noise which is not written reads.
        self.read: list[Stored] = []

    def kept(self) -> list[Stored]:
        return super().kept() + self.read + ([self.weights_table] if self.weights_table else [])

    def mixture(self) -> Column:
        gamma, eps = self.trainer.gamma, self.trainer.eps
        total = F.lit(eps) * F.col("x") * F.col("s") + F.lit(gamma) * F.col("bg") + super().mixture()
        return total / F.lit(1.0 + eps + gamma)

    def noise_count(self) -> Column:
        return F.lit(self.trainer.eps) * F.col("x") * F.col("s") * F.col("share")

    def document_sums(self) -> dict[str, Column]:
        return {**super().document_sums(), "noise_count": self.noise_count()}

    def word_sums(self, frozen: bool) -> dict[str, Column]:
        background = F.lit(self.trainer.gamma) * F.col("bg") * F.col("share")
        return {**({} if frozen else super().word_sums(frozen)), "background_count": background}

    def needs_words(self, frozen: bool) -> bool:
        return not (frozen and self.fixed_background)

    def theta_extra(self) -> list[Column]:
        return [ratio_or(F.lit(1.0), F.coalesce("noise_count", F.lit(0.0)), F.lit(0.0)).alias("s")]

    def counted(self, words: DataFrame, frozen: bool) -> DataFrame:
        counts = [] if frozen else self.counts(words)
        background = F.coalesce("background_count", F.lit(0.0)).alias("background_count")
        return words.select("word_id", *self.ps(), *counts, background)

    def new_phi(self, table: DataFrame, frozen: bool) -> DataFrame:
        """With the background normalised; all zero where it has no weight."""
        total = table.agg(F.sum("background_count")).first()[0] or 0.0
        scale = 1.0 / total if total > 0 and self.trainer.gamma != 0 else 0.0
        background = (F.col("background_count") * F.lit(scale)).alias("bg")
        if frozen:
            return table.select("word_id", *self.ps(), background)
        return self.normalised(table, background)

    def begin_round(self) -> None:
        # Rows that met their rare words by shuffle are beside their documents again only once they are written.
        if self.unwritten >= _UNWRITTEN_ROUNDS or not self.fits(self.unwritten + 1):
            self.write_noise()

    def begin_last_pass(self) -> None:
        if not self.fits(self.unwritten + 1):
            self.write_noise()

    def fits(self, tables: int, names: bool = False) -> bool:
        """Whether so many rounds' probabilities of all words fit a broadcast together, with the words' ``names`` also beside these."""
        vocabulary = self.corpus.vocabulary
        size = tables * vocabulary.broadcast_size(_row_bytes(self.trainer.topics + 1))
        return size + (vocabulary.broadcast_size() if names else 0) <= self.corpus.broadcast_bytes

    def advance(self, theta: Stored, sums: Stored | None, phi: DataFrame | None) -> None:
        if not self.unwritten and not self.weights_table:
            self.read = [table.keep() for table in self.corpus.owned]
        self.bag = self.next_bag()
        self.unwritten += 1
        super().advance(theta, sums, phi)

    def leave(self, tables: list[Stored]) -> None:
        self.read += tables

    def next_bag(self) -> DataFrame:
        """The bag with the next round's unnormalised noise, from the tables of this round."""
        rows = self.rows(self.corpus.buckets).withColumn("share", self.share())
        noise = F.coalesce(self.noise_count(), F.lit(0.0)).alias("x")
        return rows.select("doc_id", "word_id", "n", noise)

    def write_noise(self) -> None:
        """Write the bag with its noise, and let go of what it was worked out from."""
        if not self.unwritten:
            return
        written = store_bucketed(self.bag, "weights", "doc_id", self.corpus.buckets)
        for table in self.read + ([self.weights_table] if self.weights_table else []):
            table.drop()
        self.weights_table, self.bag, self.read, self.unwritten = written, written.frame, [], 0

    def settle(self) -> Stored:
        """Write the noise of a finished run; what it was worked out from stays, since results may read it."""
        self.read, self.weights_table = [], None
        self.write_noise()
        return self.weights_table

    # -- results ---------------------------------------------------------------

    def noise(self) -> DataFrame:
        """(doc_id, token, noise)."""
        joined = self.bag.join(self.theta.select("doc_id", "s").hint("shuffle_hash"), "doc_id")
        words = self.corpus.vocabulary.frame.select("word_id", "token")
        head = self.corpus.vocabulary.head(limit=self.corpus.broadcast_bytes)
        named = join_words(joined, words, head, self.corpus.vocabulary.size)
        return named.select("doc_id", "token", (F.col("x") * F.col("s")).alias("noise"))

    def background(self) -> DataFrame:
        """(token, bg)."""
        words = self.corpus.vocabulary.frame.select("word_id", "token")
        return self.phi.select("word_id", "bg").join(words, "word_id").select("token", "bg")
