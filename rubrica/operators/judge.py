"""Judges behind one protocol: prompts, calls with limits and a fallback, answers as columns.

A provider is a function of (prompt, image bytes or None) that returns a text, or raises. judged() asks every distinct prompt once, from at
most `max_concurrent` tasks, each with its share of the request limit; answers are written before they are joined back, so neither a
second action nor a retried task of a later stage pays for a call again. Answers of earlier runs are taken from a cache (AnswerCache). A provider
whose attribute `local` is true is asked without pauses. Pictures are joined to the distinct prompts that show them, not to the rows.
"""

from __future__ import annotations

import copy
import hashlib
import random
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.config import EngineConfig, effective_limit
from rubrica.functions import scalars as S
from rubrica.functions.normalize import SPACES, strip
from rubrica.operators.quota import Admission, Breaker
from rubrica.plans.staging import delete, exists, hadoop_path, stage

Provider = Callable[[str, bytes | None], str]
# Answer keys, in order of trial on a line.
PDF_KEYS = {
    "TITLE_MATCH:": "title_match", "EXPERT_DETAILS:": "expert_details", "LEARNING_OUTCOMES_ALIGN:": "learning_outcomes",
    "OBJECTIVES_MATCH:": "objectives", "PARTICIPANTS_VALID:": "participants", "REASONING:": "reasoning",
}
IMAGE_KEYS = {
    "HAS_BANNER:": "has_banner", "BANNER_TEXT_MATCHES:": "banner_text_matches", "IS_REAL_EVENT:": "is_real_event", "MODE_MATCHES:": "mode_matches",
    "PARTICIPANT_COUNT:": "participant_count", "HAS_15_PLUS_PARTICIPANTS:": "has_15_plus", "REASONING:": "reasoning",
}
CONSISTENCY_KEYS = {"TITLE_MATCH:": "title_match", "OBJECTIVES_MATCH:": "objectives", "LEARNING_MATCH:": "learning_outcomes", "PARTICIPANTS_VALID:": "participants"}
REVIEW_KEYS = {
    "TITLE_MATCH:": "title_match", "OBJECTIVES_MATCH:": "objectives", "LEARNING_MATCH:": "learning_outcomes", "EXPERT_DETAILS:": "expert_details",
    "PARTICIPANTS_VALID:": "participants", "THEME_ALIGNMENT:": "theme_alignment", "REASONING:": "reasoning",
}
TEXT_FIELDS, NUMBER_FIELDS = {"reasoning"}, {"participant_count"}


# --- answers ---


def says_yes(answer: Column) -> Column:
    return F.coalesce(F.upper(answer).contains("YES"), F.lit(False))


def line_pattern(keys: list[str], i: int, line: str) -> str:
    """The last line that holds keys[i] and none of the keys before it, as one pattern; `line` matches the line itself."""
    key = re.escape(keys[i])
    earlier = "|".join(map(re.escape, keys[:i]))
    return rf"(?s)^(?:.*\n)?{f'(?![^\n]*(?:{earlier}))' if earlier else ''}(?=[^\n]*{key}){line}(?=\n|\z)"


def verdict(answer: Column, keys: dict[str, str]) -> Column:
    """A struct of flags: a line belongs to the first key it contains, the last line of a key counts.

    The count is that of the last line whose text between its first two colons is a whole number, else 0. Where every line begins with its key and
    has no other colon, as answers should, the lines are found by plain search; patterns serve the rest.
    """
    names, fields = list(keys), []
    simple = answer.rlike(rf"\A(?:(?:{'|'.join(map(re.escape, names))})[^\n:]*(?:\n|\z))*\z")
    for i, (key, name) in enumerate(keys.items()):
        if name in NUMBER_FIELDS:
            found = F.regexp_extract(answer, line_pattern(names, i, r"[^\n:]*:[^\S\n]*([+-]?\d+)[^\S\n]*(?::[^\n]*)?"), 1)
            value = F.when(answer.contains(key), F.coalesce(found.try_cast("int"), F.lit(0))).otherwise(0)
        else:
            text = name in TEXT_FIELDS
            quick = F.substring_index(F.substring_index(answer, key, -1), "\n", 1)
            slow = F.regexp_extract(answer, line_pattern(names, i, r"[^\n:]*:([^\n]*)" if text else r"([^\n]*)"), 1)
            line = F.when(~answer.contains(key), "").when(simple, quick).otherwise(slow)
            value = F.coalesce(strip(line), F.lit("")) if text else says_yes(line)
        fields.append(value.alias(name))
    return F.struct(*fields)


# --- prompts ---


def given(c: Column, default: str = "not given") -> Column:
    return F.when(c.isNull() | (c == ""), default).otherwise(c)


def asked(task: str, facts: dict[str, Column], keys: dict[str, str] | None = None) -> Column:
    """A prompt: the task, the named facts, and the lines that an answer must have."""
    parts = [F.lit(task)]
    for name, value in facts.items():
        parts += [F.lit(f"\n{name}: "), value]
    how = "\nAnswer with one word, YES or NO."
    if keys:
        kind = lambda n: "a short reason" if n in TEXT_FIELDS else "a whole number" if n in NUMBER_FIELDS else "YES or NO"
        how = "\nAnswer in these lines only:\n" + "\n".join(f"{k} {kind(n)}" for k, n in keys.items())
    return F.concat(*parts, F.lit(how))


def theme_prompt(title: Column, objectives: Column, outcomes: Column, theme: Column) -> Column:
    """Null for an empty theme: such a row fails without a call."""
    facts = {"Theme": theme, "Title": title, "Objectives": objectives, "Learning outcomes": outcomes}
    return F.when(theme != "", asked("Do the title, the objectives and the learning outcomes of this event fit its theme?", facts))


def pdf_prompt(body: Column, title: Column, objectives: Column, outcomes: Column, participants: Column, config: EngineConfig = EngineConfig()) -> Column:
    """One call for all five rules of a report, on the first text_chars characters; null without text."""
    facts = {
        "Expected title": given(title), "Expected objectives": given(objectives), "Expected learning outcomes": given(outcomes),
        "Expected participants": given(participants.cast("string"), "15 at least"), "Report": F.substring(body, 1, config.text_chars),
    }
    return F.when(body != "", asked("Hold the report of this event against what is expected of it. Similar meaning suffices; 15 participants are needed.", facts, PDF_KEYS))


def image_prompt(mode: Column, title: Column, theme: Column) -> Column:
    facts = {"Expected mode": given(F.lower(mode)), "Title": given(title), "Theme": given(theme)}
    return asked("Say what this photograph of the event shows: a banner, a real activity, the mode (online or offline), and how many people.", facts, IMAGE_KEYS)


def consistency_prompt(body: Column, title: Column, objectives: Column, outcomes: Column, participants: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The narrower question of four flags, on the first legacy_text_chars characters."""
    facts = {"Title": given(title), "Objectives": given(objectives), "Learning outcomes": given(outcomes), "Participants": given(participants.cast("string")), "Report": F.substring(body, 1, config.legacy_text_chars)}
    return F.when(body != "", asked("Is the report consistent with these facts?", facts, CONSISTENCY_KEYS))


def review_prompt(body: Column, title: Column, objectives: Column, outcomes: Column, theme: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The wider question of six flags and a reason, on the first legacy_text_chars characters."""
    facts = {"Title": given(title), "Objectives": given(objectives), "Learning outcomes": given(outcomes), "Theme": given(theme), "Report": F.substring(body, 1, config.legacy_text_chars)}
    return F.when(body != "", asked("Review the report against these facts and the theme.", facts, REVIEW_KEYS))


# --- calls ---


def limited(message: str, fallback: bool = False) -> bool:
    """Whether an error message tells of a rate limit."""
    return any(mark in message.lower() for mark in (S.FALLBACK_MARKS if fallback else S.PRIMARY_MARKS))


def wait_after(message: str, attempt: int, fallback: bool = False) -> float:
    """Python twin of scalars.backoff()."""
    if not limited(message, fallback):
        return 1.0
    for pattern in S.FALLBACK_DELAYS if fallback else S.PRIMARY_DELAYS:
        found = re.search(pattern, message, re.I)
        if found and (delay := float(found[1]) + 0.5 * fallback) > 0:
            return delay if fallback else max(delay, 5.0)
    return min(2.0 * 2**attempt, 60.0)


@dataclass
class Client:
    """One provider with its breaker, limiter and retries, and another client to fall back to."""

    provider: Provider
    config: EngineConfig = EngineConfig()
    is_fallback: bool = False
    fallback: Client | None = None
    #: Tasks that share the request limit.
    shares: int = 1
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    on_limit: Callable[[], None] | None = None
    #: Set by race(): no further attempt is made once the other side has answered.
    given_up: threading.Event = field(default_factory=threading.Event)

    def __post_init__(self) -> None:
        c = self.config
        rpm = effective_limit(c.fallback_rpm, c.fallback_safety) if self.is_fallback else effective_limit(c.rpm, c.safety)
        self.breaker = Breaker(c)
        self.limiter = Admission(max(1, rpm // self.shares))
        self.known: dict[str, str] = {}

    def pause(self, prompt: str, image: bytes | None) -> None:
        if getattr(self.provider, "local", False):
            return
        spread = random.uniform(self.config.jitter_low, self.config.jitter_high)
        delay = self.limiter.delay(self.clock(), len(prompt) // 4 + 1000 * (image is not None)) * spread
        if delay > 0:
            self.sleep(delay)
        self.limiter.record(self.clock())

    def other(self, prompt: str, image: bytes | None) -> str | None:
        return self.fallback.ask(prompt, None) if self.fallback and image is None else None

    def ask(self, prompt: str, image: bytes | None = None) -> str | None:
        """The answer, or null if no provider gives one; never raises for a failing provider."""
        if image is None and prompt in self.known:
            return self.known[prompt]
        if not self.breaker.can_proceed(self.clock()):
            return self.other(prompt, image)
        self.pause(prompt, image)
        for attempt in range(self.config.attempts):
            if self.given_up.is_set():
                return None
            if attempt and not self.breaker.can_proceed(self.clock()):
                return self.other(prompt, image)
            try:
                answer = self.provider(prompt, image)
            except Exception as error:  # any failure of a provider is data, not a failure of the job
                message, last = str(error), attempt == self.config.attempts - 1
                if limited(message, self.is_fallback):
                    self.breaker.record(self.clock(), "limit")
                    if not self.breaker.can_proceed(self.clock()):
                        return self.other(prompt, image)
                    if self.on_limit:
                        self.on_limit()
                    self.sleep(wait_after(message, attempt, self.is_fallback))
                    self.pause(prompt, image)
                elif not (last and self.is_fallback):
                    self.sleep(1.0)
                if last:
                    if self.is_fallback:
                        self.breaker.record(self.clock(), "limit" if limited(message, True) else "error")
                    return self.fallback.ask(prompt, None) if self.fallback else None
                continue
            if not answer:
                return None
            answer = answer.strip(SPACES)
            self.breaker.record(self.clock(), "success")
            if image is None:
                self.known[prompt] = answer
            return answer
        return None


    def race(self, prompt: str) -> str | None:
        """As ask(), but where no answer comes, one more try of this provider and the fallback run at once: the first answer wins, the other side is given up.

        A call that is under way is not waited for. Each side has its own breaker and limiter, so the two threads share no state.
        """
        answer = self.ask(prompt)
        if answer or not self.fallback:
            return answer
        alone, other = copy.copy(self), copy.copy(self.fallback)
        alone.fallback, alone.known, alone.given_up, other.given_up = None, {}, threading.Event(), threading.Event()
        pool = ThreadPoolExecutor(2)
        try:
            for done in as_completed([pool.submit(side.ask, prompt) for side in (alone, other)]):
                if answer := done.result():
                    self.known[prompt] = answer
                    return answer
            return None
        finally:
            alone.given_up.set()
            other.given_up.set()
            pool.shutdown(wait=False, cancel_futures=True)


class AnswerCache:
    """Answers by key in a shared folder, in buckets of the key's first `width` characters, a part for each run.

    A run reads only the buckets of its own keys; keys are sorted in a file, with Parquet's Bloom filter. A part appears whole, by a rename, so runs may append at once.
    compact() merges the parts that it sees and leaves those that come meanwhile.
    """

    def __init__(self, spark: SparkSession, folder: str, width: int = 1) -> None:
        self.spark, self.folder, self.width = spark, folder.rstrip("/"), width

    def parts(self) -> list[str]:
        if not exists(self.spark, self.folder):
            return []
        path, fs = hadoop_path(self.spark, self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("run="))

    def rows(self, parts: list[str] | None = None) -> DataFrame:
        """(key, answer, bucket), each key once; of some parts or all."""
        parts = self.parts() if parts is None else parts
        schema = "key string, answer string, bucket string"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, run string").option("basePath", self.folder).parquet(*[f"{self.folder}/{p}" for p in parts]).select("key", "answer", "bucket")

    def known(self, keys: DataFrame) -> DataFrame:
        """(key, answer) of keys (key) that have one; only their buckets are read."""
        wanted = [r[0] for r in keys.select(F.substring("key", 1, self.width)).distinct().collect()]  # at most 16 to the power of width
        found = self.rows().where(F.col("bucket").isin(wanted)) if wanted else self.rows([])
        return found.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.min("answer").alias("answer"))

    def add(self, answers: DataFrame) -> None:
        name, rows = uuid.uuid4().hex, answers.where("answer is not null").select("key", "answer", F.substring("key", 1, self.width).alias("bucket"))
        hidden = f"{self.folder}/.new-{name}"
        ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "key")
        ordered.write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("bucket").parquet(hidden)
        (source, fs), (target, _) = hadoop_path(self.spark, hidden), hadoop_path(self.spark, f"{self.folder}/run={name}")
        if not fs.rename(source, target):
            raise OSError(f"{hidden} could not be renamed")

    def compact(self) -> None:
        old = self.parts()
        if len(old) > 1:
            self.add(self.rows(old).groupBy("key").agg(F.min("answer").alias("answer")))
            for part in old:
                delete(self.spark, f"{self.folder}/{part}")


def stub_judge(prompt: str, image: bytes | None = None) -> str:
    """The default provider: a fixed function of the prompt."""
    return "YES" if int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16) % 2 == 0 else "NO"


def stub_verdicts(prompt: str, image: bytes | None = None) -> str:
    """A fixed function of the prompt that answers every key that the prompt asks for."""
    seed = hashlib.sha256(prompt.encode() + (image or b"")).digest()
    names = [k for keys in (PDF_KEYS, IMAGE_KEYS, CONSISTENCY_KEYS, REVIEW_KEYS) for k in keys if f"\n{k} " in prompt]
    if not names:
        return stub_judge(prompt)
    value = lambda i, k: str(seed[i] % 40) if k == "PARTICIPANT_COUNT:" else "fixed" if k == "REASONING:" else ("YES", "NO")[seed[i] % 2]
    return "\n".join(f"{k} {value(i, k)}" for i, k in enumerate(dict.fromkeys(names)))


stub_judge.local = stub_verdicts.local = True


def judged(
    df: DataFrame, prompt: str, provider: Provider = stub_judge, answer: str = "answer", *, image: str | None = None, pictures: DataFrame | None = None, fallback: Provider | None = None,
    config: EngineConfig = EngineConfig(), cache: str | None = None, hedged: bool = False, on_limit: Callable[[], None] | None = None,
) -> DataFrame:
    """df with the answer to each row's prompt (and image); null and empty prompts are never asked, failed ones have no answer.

    image is a binary column, or with `pictures` (path, sha256, content) the column of its path. cache is a folder of answers (AnswerCache). hedged: where
    the provider gives no answer, it and the fallback race. on_limit is called in the task that meets a rate limit.
    """
    kept, names = [F.col(f"`{c}`") for c in df.columns], {"key": "judge_key", "said": "judge_said", "shown": "judge_shown", "seen": "judge_seen"}
    while any(n in df.columns for n in names.values()):
        names = {k: f"{v}_" for k, v in names.items()}
    key, said, shown, seen = names.values()
    if pictures is not None:
        df = df.join(pictures.select(F.col("path").alias(shown), F.col("sha256").alias(seen)), F.col(f"`{image}`") == F.col(shown), "left").drop(shown)
    content = F.lit("") if image is None else F.coalesce(F.col(seen) if pictures is not None else F.sha2(F.col(f"`{image}`"), 256), F.lit(""))
    keyed = df.withColumn(key, F.when(F.col(f"`{prompt}`") != "", F.sha2(F.concat_ws("|", F.col(f"`{prompt}`"), content), 256)))
    picture = F.lit(None).cast("binary") if image is None else F.col(f"`{image}`")
    wanted = keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(f"`{prompt}`").alias("prompt"), picture.alias("image"))
    wanted = wanted.groupBy("key").agg(F.first("prompt").alias("prompt"), F.first("image").alias("image"))
    known = None
    if cache:
        wanted = stage(wanted, "wanted")
        known = stage(AnswerCache(df.sparkSession, cache).known(wanted), "known")
        wanted = wanted.join(known, "key", "left_anti")
    if pictures is not None:
        wanted = wanted.join(pictures.select(F.col("path").alias("image"), "content"), "image", "left").select("key", "prompt", F.col("content").alias("image"))
    tasks = config.max_concurrent

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        second = Client(fallback, replace(config), is_fallback=True, shares=tasks) if fallback else None
        client = Client(provider, config, fallback=second, shares=tasks, on_limit=on_limit)
        for pdf in batches:
            got = [client.race(p) if hedged and i is None else client.ask(p, None if i is None else bytes(i)) for p, i in zip(pdf["prompt"], pdf["image"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "answer": pd.Series(got, dtype=object)})

    fresh = stage(wanted.repartition(tasks, "key").mapInPandas(ask, "key string, answer string"), "answers")
    if cache:
        AnswerCache(df.sparkSession, cache).add(fresh)
    answers = fresh if known is None else fresh.unionByName(known)
    answers = answers.select(F.col("key").alias(key), F.col("answer").alias(said))
    return keyed.join(answers, key, "left").select(*kept, F.col(said).alias(answer))
