"""Relevance of files to tasks, and packing the best of them into a token budget.

Tasks and files meet on terms: a task's terms are joined with the words of the
files of its project.  A term may be any part of a word, so words are cut into
the parts that a term could equal: where the text lies, each word once a task,
while the terms are few enough to be sent there; otherwise the vocabulary is cut,
which gives an index of the words that matter, and the text is read past it.  Files that
share no term with a task keep a base score that does not depend on the task;
only as many of them as a budget could hold are brought in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import paths, tasks as tk, text
from ..functions.text import TRUNCATION_MARKER
from ..session import cut
from .graph import IMPORT_EXTENSIONS
from .ranking import top_k

# Score weights (in path, per match in text, most points in text).
WEIGHTS = {"keyword": (15, 2, 20), "domain": (20, 3, 30), "framework": (10, 0, 0)}
MENTION_POINTS, FOCUS_POINTS, TEST_POINTS = 100, 50, 15

# Budget shares by strategy.
SHARES = {
    "relevance": {"files": 0.6, "dependencies": 0.15, "architecture": 0.1, "tests": 0.1, "types": 0.05},
    "breadth": {"files": 0.5, "dependencies": 0.2, "architecture": 0.15, "tests": 0.1, "types": 0.05},
    "depth": {"files": 0.7, "dependencies": 0.15, "architecture": 0.05, "tests": 0.05, "types": 0.05},
}

# Terms, or words with a term, that are sent to all tasks at most, and the parts of a word when there are more.
INDEX_WORDS, HOT_PARTS = 200_000, 32
# Words whose terms a task remembers, then it begins anew, and the first characters of a term that are looked up.
WORDS_KEPT, HEAD = 300_000, 4


def analyse_tasks(tasks: DataFrame) -> DataFrame:
    """Kind and term lists of every task."""
    body = F.col("task")
    return tasks.select(
        *tasks.columns, tk.task_kind(body).alias("kind"), tk.keywords(body).alias("keywords"),
        tk.listed(body, tk.ACTION_VERBS).alias("actions"), tk.listed(body, tk.FRAMEWORK_CONCEPTS).alias("framework_concepts"),
        tk.listed(body, tk.DOMAIN_CONCEPTS).alias("domain_concepts"), tk.mentioned_files(body).alias("mentioned"),
    )


def allocate_budget(tasks: DataFrame, include: Sequence[str] = ("architecture", "dependencies", "tests", "types")) -> DataFrame:
    """Token budgets by category; categories that are not asked for get nothing."""
    def share(name):
        if name != "files" and name not in include:
            return F.lit(0).cast("bigint").alias(f"budget_{name}")
        part = F.lit(SHARES["depth"][name])
        for strategy in ("relevance", "breadth"):
            part = F.when(F.col("strategy") == strategy, SHARES[strategy][name]).otherwise(part)
        return F.floor(F.col("max_tokens") * part).alias(f"budget_{name}")

    return tasks.select(*tasks.columns, *[share(n) for n in SHARES["relevance"]])


def task_terms(analysed: DataFrame) -> DataFrame:
    groups = [("keyword", "keywords"), ("domain", "domain_concepts"), ("framework", "framework_concepts")]
    def tagged(group, column):
        return F.transform(F.col(column), lambda t: F.struct(F.lit(group).alias("group"), t.alias("term")))

    rows = F.flatten(F.array(*[tagged(group, column) for group, column in groups]))
    return analysed.select("project", "task_id", F.explode(rows).alias("t")).select("project", "task_id", "t.group", "t.term")


def file_base(files: DataFrame, focus: Sequence[str] = ()) -> DataFrame:
    """Size and task-independent points of every file; no text is kept."""
    path, content = F.col("path"), F.col("content")
    points = F.lit(0)
    for area in focus:
        points = points + F.when(path.contains(area), FOCUS_POINTS).otherwise(0)
    test = paths.is_test_file(path)
    return files.select(
        "project", "path", F.length(content).cast("bigint").alias("chars"), text.est_tokens(content).alias("tokens"), test.alias("is_test"),
        points.alias("focus_points"), F.when(test & F.lower(content).contains("test"), TEST_POINTS).otherwise(0).alias("test_points"),
    )


def words_in(column: str) -> Column:
    """Words of a text in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"\w+"), F.lit(0))


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast stored rows that are measured to be few."""
    return F.broadcast(rows) if rows.count() <= INDEX_WORDS else rows


def term_index(files: DataFrame, terms: DataFrame) -> DataFrame:
    """``(word, held)``: the words of the corpus that hold a term, each with its ``(term, inside)`` pairs.

    Every distinct word is cut into its parts of the lengths that terms have, from
    the places on where the first characters of a term stand, and parts meet terms
    by equality; the text itself is not joined with anything.
    """
    terms = cut(terms)
    lengths = [r[0] for r in terms.select(F.length("term").alias("n")).distinct().sort("n").collect()] or [1]  # a few numbers
    first = lengths[0]
    heads = cut(terms.select(F.substring("term", 1, first).alias("head")).distinct())
    vocabulary = files.select(F.explode(F.concat(words_in("content"), words_in("path"))).alias("word")).filter(F.length("word") >= first).distinct()
    places = vocabulary.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - first + 1)).alias("at"))
    begun = places.withColumn("head", F.substr("word", F.col("at"), F.lit(first))).join(_few(heads), "head", "left_semi")
    parts = begun.select("word", "at", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).filter(
        F.col("at") + F.col("n") - 1 <= F.length("word")).select("word", F.substr("word", F.col("at"), F.col("n")).alias("term"))
    inside = ((F.length("word") - F.length(F.replace("word", F.col("term"), F.lit("")))) / F.length("term")).cast("bigint")
    return parts.join(_few(terms), "term").groupBy("word").agg(F.collect_set(F.struct("term", inside.alias("inside"))).alias("held"))


def _posted(asked: Sequence[tuple]) -> Callable:
    """Counts of the asked ``(project, term)`` in batches of ``(project, path, text, place)``, texts in lower case.

    A task looks each different word up once: parts of it are looked for among the
    first characters of the terms.  Words are then counted file by file.
    """
    def count(batches):
        wanted: dict = {}
        for project, term in asked:
            wanted.setdefault(project, set()).add(term)
        begun: dict = {}
        for term in sorted({term for _, term in asked}):
            begun.setdefault(term[:HEAD], []).append(term)
        short = [term for term in begun if len(term) < HEAD]
        word, known = re.compile(r"\w+", re.ASCII), {}

        def held(w):
            if w not in known:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                heads = {w[i:i + HEAD] for i in range(len(w) - HEAD + 1)}
                inside = [term for head in heads & begun.keys() for term in begun[head] if term in w] + [term for term in short if term in w]
                known[w] = [(term, w.count(term)) for term in inside]
            return known[w]

        for batch in batches:
            out: list[tuple] = []
            for project, path, text, place in zip(*(column.to_pylist() for column in batch.columns)):
                mine = wanted.get(project)
                if not mine:
                    continue
                found = {term: [True, 0] for w in set(word.findall(place)) for term, _ in held(w) if term in mine}
                for w, times in Counter(word.findall(text)).items():
                    for term, inside in held(w):
                        if term in mine:
                            found.setdefault(term, [False, 0])[1] += times * inside
                out += [(project, path, term, in_path, n) for term, (in_path, n) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, [
                *(batch.schema.types[:2]), pa.string(), pa.bool_(), pa.int64()])], ["project", "path", "term", "in_path", "n"])

    return count


def term_postings(files: DataFrame, asked: DataFrame) -> DataFrame:
    """``(project, path, term, in_path, n)``: the files of every ``(project, term)`` asked for, and how often their text holds the term.

    Up to a measured number of terms are sent to all tasks, and a text is read
    once where it lies: only its terms leave the task.  More terms are met
    through ``term_index``, dealt out by word, frequent words over many tasks by a hash of the file.
    """
    asked = cut(asked.filter("project IS NOT NULL AND term <> ''"))
    keys = ["project", "path", "term"]
    if asked.count() <= INDEX_WORDS:
        low = files.select("project", "path", *[F.lower(F.coalesce(c, F.lit(""))).alias(n) for c, n in (("content", "text"), ("path", "place"))])
        schema = StructType([*low.schema.fields[:2], *StructType.fromDDL("term string, in_path boolean, n long").fields])
        met = low.mapInArrow(_posted([tuple(r) for r in asked.select("project", "term").distinct().collect()]), schema)
        # Dealt out by file, so that sums of a file's terms by task need no other shuffle.
        return met.repartition("project", "path").groupBy(*keys).agg(F.max("in_path").alias("in_path"), F.sum("n").alias("n"))
    index = cut(term_index(files, asked.select("term").distinct()))
    spoken = files.select("project", "path", F.explode(F.concat(
        F.transform(words_in("content"), lambda w: F.struct(w.alias("word"), F.lit(False).alias("in_path"))),
        F.transform(words_in("path"), lambda w: F.struct(w.alias("word"), F.lit(True).alias("in_path"))),
    )).alias("w")).select("project", "path", "w.word", "w.in_path")
    if index.count() <= INDEX_WORDS:  # a word holds few terms
        met = spoken.join(F.broadcast(index), "word")
    else:
        salted = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))))
        met = spoken.withColumn("part", F.pmod(F.xxhash64("project", "path"), F.lit(HOT_PARTS)).cast("int")).join(salted, ["word", "part"])
    met = met.select("project", "path", "in_path", F.explode("held").alias("h")).select("project", "path", "in_path", "h.term", "h.inside")
    return met.join(_few(asked), ["project", "term"], "left_semi").groupBy(*keys).agg(
        F.max("in_path").alias("in_path"), F.sum(F.when(F.col("in_path"), 0).otherwise(F.col("inside"))).alias("n"))


def term_matches(files: DataFrame, terms: DataFrame) -> DataFrame:
    """Where each term occurs in the files of the projects that ask for it: ``(project, path, term, in_path, n)``."""
    wanted = terms.select("project", "term").distinct()
    found = term_postings(files, wanted.filter(F.col("term").rlike(r"^\w+$")))

    # The fixed vocabulary has a few terms that are not plain words; they are counted in place.
    odd = [w for w in [*tk.DOMAIN_CONCEPTS, *tk.FRAMEWORK_CONCEPTS] if not w.replace("_", "").isalnum()]
    low = F.lower(F.coalesce("content", F.lit("")))
    direct = files.select("project", "path", F.explode(F.array(*[F.struct(
        F.lit(w).alias("term"), F.lower("path").contains(w).alias("in_path"),
        ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("bigint").alias("n")) for w in odd])).alias("t"))
    direct = direct.select("project", "path", "t.*").filter("in_path OR n > 0").join(wanted, ["project", "term"], "left_semi")
    return found.unionByName(direct)


def term_points(matches: DataFrame, terms: DataFrame) -> DataFrame:
    """Points and reasons from terms and mentions, for pairs that share at least one."""
    joined = terms.join(matches, ["project", "term"])
    n, points = F.col("n"), F.lit(0)
    for group, (in_path, each, most) in WEIGHTS.items():
        gained = F.when(F.col("in_path"), in_path).otherwise(0) + F.least(n * each, F.lit(most))
        points = F.when(F.col("group") == group, gained).otherwise(points)
    return joined.select("project", "task_id", "path", "group", "term", "in_path", "n", points.cast("bigint").alias("points"))


def mention_points(files: DataFrame, analysed: DataFrame) -> DataFrame:
    said = analysed.select("project", "task_id", F.explode("mentioned").alias("mention"))
    named = files.select("project", "path", F.explode(tk.mentions_of_path(F.col("path"))).alias("mention"))
    return said.join(named, ["project", "mention"]).select("project", "task_id", "path").distinct().withColumn(
        "points", F.lit(MENTION_POINTS).cast("bigint"))


def matched_scores(files: DataFrame, analysed: DataFrame, focus: Sequence[str] = ()) -> DataFrame:
    """Score of every (task, file) pair that shares a term or a mention."""
    terms = cut(task_terms(analysed))
    by_term = term_points(term_matches(files, terms), terms).select("project", "task_id", "path", "points")
    summed = by_term.unionByName(mention_points(files, analysed)).groupBy("project", "task_id", "path").agg(F.sum("points").alias("points"))
    scored = summed.filter("points > 0").join(file_base(files, focus), ["project", "path"])
    return _with_score(scored.join(analysed.select("project", "task_id", "kind"), ["project", "task_id"]))


def _with_score(pairs: DataFrame) -> DataFrame:
    test = F.when(F.col("is_test") & (F.col("kind") == "bug"), TEST_POINTS).otherwise(F.col("test_points"))
    return pairs.withColumn("score", F.col("points") + F.col("focus_points") + test).select(
        "project", "task_id", "path", "score", "tokens", "chars", "is_test")


def candidates(matched: DataFrame, base: DataFrame, analysed: DataFrame, bound: int) -> DataFrame:
    """The first ``bound`` non-empty files of every task, by score and then path.

    Beside the matched files only the first ``2 * bound`` files by base score can
    be among them: were more than ``bound`` of those matched, they would rank
    above every file that was left out.
    """
    full = base.filter("tokens > 0")
    bug = full.withColumn("rest", F.col("focus_points") + F.when(F.col("is_test"), TEST_POINTS).otherwise(0)).withColumn("bug", F.lit(True))
    other = full.withColumn("rest", F.col("focus_points") + F.col("test_points")).withColumn("bug", F.lit(False))
    fill = top_k(bug.unionByName(other), ["project", "bug"], [F.desc("rest"), F.col("path")], 2 * bound).drop("rank")
    asked = analysed.select("project", "task_id", "kind", (F.col("kind") == "bug").alias("bug"))
    rest = asked.join(fill, ["project", "bug"]).join(matched, ["project", "task_id", "path"], "left_anti")
    rest = _with_score(rest.withColumn("points", F.lit(0).cast("bigint")))
    return top_k(matched.filter("tokens > 0").unionByName(rest), ["project", "task_id"], [F.desc("score"), F.col("path")], bound)


PICK = "array<struct<rank:int,path:string,score:bigint,used:bigint,truncated:boolean>>"


def pack(ranked: DataFrame, budgets: DataFrame, budget: str, category: str, stop_share: float | None = None) -> DataFrame:
    """Greedy packing of ranked files into each task's budget.

    A file that does not fit is cut to what is left, and packing goes on until the
    budget is used (or ``stop_share`` of it is).  Every packed file costs at least
    one token, so a task folds at most ``budget`` candidates.
    """
    limited = ranked.join(budgets.select("project", "task_id", F.col(budget).alias("_budget")), ["project", "task_id"]).filter(
        F.col("rank") <= F.col("_budget"))
    rows = limited.groupBy("project", "task_id", "_budget").agg(
        F.sort_array(F.collect_list(F.struct("rank", "path", "score", "tokens", "chars"))).alias("files"))
    marker = len(TRUNCATION_MARKER)
    cut_chars = f"floor((_budget - a.used) * 4 * 0.6D) + floor((_budget - a.used) * 4 * 0.2D) + {marker}"
    takes = f"CASE WHEN f.tokens > _budget - a.used THEN bigint(ceil(({cut_chars}) / 4)) ELSE f.tokens END"
    stop = "a.used >= _budget" + (f" OR a.used > _budget * {stop_share}D" if stop_share else "")
    fold = f"""aggregate(files, named_struct('used', 0L, 'picks', cast(array() AS {PICK})),
      (a, f) -> CASE WHEN {stop} THEN a ELSE named_struct('used', a.used + {takes},
        'picks', array_append(a.picks, named_struct('rank', f.rank, 'path', f.path, 'score', f.score, 'used', {takes}, 'truncated', f.tokens > _budget - a.used))) END)"""
    packed = rows.select("project", "task_id", F.explode(F.expr(fold)["picks"]).alias("p"))
    return packed.select("project", "task_id", F.lit(category).alias("category"), "p.path", "p.score", "p.rank",
                         F.col("p.used").alias("tokens"), "p.truncated")


def dependency_candidates(primary: DataFrame, imports: DataFrame, base: DataFrame, matched: DataFrame, analysed: DataFrame, bound: int) -> DataFrame:
    """Files that packed files import, the first ``bound`` by score; some may be packed already."""
    wanted = primary.select("project", "task_id", "path").join(imports.filter(F.col("source").startswith(".")), ["project", "path"])
    key = paths.normalize_path(F.concat(paths.dirname(F.col("path")), F.lit("/"), F.col("source")))
    wanted = wanted.select("project", "task_id", key.alias("key")).distinct()
    ext = F.array_position(F.array(*[F.lit(e) for e in IMPORT_EXTENSIONS]), paths.extname(F.col("path")))
    bare = F.substr("path", F.lit(1), F.length("path") - F.length(paths.extname(F.col("path"))))
    named = base.select("project", "path", bare.alias("key"), ext.alias("e")).filter("e > 0").groupBy("project", "key").agg(
        F.min_by("path", "e").alias("path"))
    found = wanted.join(named, ["project", "key"]).select("project", "task_id", "path").distinct()
    scored = found.join(base, ["project", "path"]).join(analysed.select("project", "task_id", "kind"), ["project", "task_id"])
    known = matched.select("project", "task_id", "path", F.col("score").alias("known"))
    plain = _with_score(scored.withColumn("points", F.lit(0).cast("bigint")))
    both = plain.join(known, ["project", "task_id", "path"], "left").withColumn("score", F.coalesce("known", "score")).drop("known")
    return top_k(both.filter("tokens > 0"), ["project", "task_id"], [F.desc("score"), F.col("path")], bound)


def context_pack(files: DataFrame, tasks: DataFrame, imports: DataFrame, focus: Sequence[str] = (),
                 dependency_limit: int | None = None) -> DataFrame:
    """Packed files of every task: primary, then dependencies, then tests.

    Dependencies are bounded by their budget, and by ``dependency_limit`` files if given.
    """
    analysed = cut(allocate_budget(analyse_tasks(tasks)))
    base = cut(file_base(files, focus))
    matched = cut(matched_scores(files, analysed, focus))
    bounds = analysed.agg(F.max("budget_files"), F.max("budget_tests"), F.max("budget_dependencies")).collect()[0]  # three numbers
    primary = cut(pack(candidates(matched, base, analysed, max(1, bounds[0] or 1)), analysed, "budget_files", "primary", 0.9))
    # A packed file costs a token at least, so no more than the budget are packed.
    most = max(1, bounds[2] or 1) if dependency_limit is None else dependency_limit
    needed = dependency_candidates(primary, imports, base, matched, analysed, most)
    dependency = cut(pack(needed, analysed, "budget_dependencies", "dependency"))
    chosen = primary.unionByName(dependency).select("project", "task_id", "path")
    # Tests already chosen are at most the packed files, so the bound grows by those budgets.
    deep = max(1, (bounds[1] or 0) + (bounds[0] or 0) + most)
    tests = candidates(matched.filter("is_test"), base.filter("is_test"), analysed, deep).drop("rank")
    tests = tests.join(chosen, ["project", "task_id", "path"], "left_anti")
    ranked = top_k(tests, ["project", "task_id"], [F.desc("score"), F.col("path")], max(1, bounds[1] or 1))
    return primary.unionByName(dependency).unionByName(pack(ranked, analysed, "budget_tests", "test"))


def budget_use(packed: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tokens by category, used and remaining, files and mean score per task."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("tokens"))), F.lit(0)).alias(f"{c}_tokens")
    used = packed.groupBy("project", "task_id").agg(
        *[of(c) for c in ("primary", "dependency", "test", "type")], F.sum("tokens").alias("used"),
        F.count(F.lit(1)).alias("files"), F.avg("score").alias("avg_score"))
    return tasks.select("project", "task_id", "max_tokens").join(used, ["project", "task_id"]).withColumn("remaining", F.col("max_tokens") - F.col("used"))


def shrink_to(packed: DataFrame, target: int) -> DataFrame:
    """Cut all files of a task by the same ratio when they exceed ``target`` tokens."""
    totals = packed.groupBy("project", "task_id").agg(F.sum("tokens").alias("total"))
    aim = F.floor(F.col("tokens") * (F.lit(target) / F.col("total")))
    shorter = F.ceil(text.truncated_length(F.col("tokens") * 4, aim) / 4)
    return packed.join(totals, ["project", "task_id"]).withColumn(
        "shrunk_tokens", F.when(F.col("total") <= target, F.col("tokens")).otherwise(shorter)).drop("total")


# Substrings that show a pattern in use.
PROJECT_PATTERNS = [
    ("React Hooks", ["useState", "useEffect"]), ("Context API", ["createContext"]), ("Vue 3 Refs", ["ref(", "ref<"]),
    ("Vue 3 Reactive State", ["reactive(", "reactive<"]), ("Vue 3 Computed Properties", ["computed(", "computed<"]),
    ("Vue 3 Watchers", ["watch(", "watchEffect("]), ("Vue 3 Script Setup", ["<script setup"]), ("Pinia Stores", ["defineStore"]),
    ("Pinia Store Refs", ["storeToRefs"]), ("Vue Router / Nuxt Routing", ["useRouter", "useRoute"]),
    ("Nuxt Data Fetching", ["useFetch", "useAsyncData"]), ("Nuxt Auto-Imports", ["navigateTo", "useNuxtApp"]),
    ("Nuxt Component Definitions", ["definePageMeta", "defineNuxtComponent"]), ("Nuxt Configuration", ["useRuntimeConfig", "useAppConfig"]),
    ("Nuxt Server Routes", ["defineEventHandler", "readBody"]), ("Nuxt UI Components", ["UButton", "UCard", "UInput", "UModal"]),
    ("React Navigation", ["useNavigation", "NavigationContainer", "createStackNavigator"]),
    ("Platform-Specific Code", ["Platform.OS", "Platform.select"]), ("React Native Animations", ["Animated.", "useAnimatedStyle", "withTiming"]),
    ("Gesture Handlers", ["GestureDetector", "PanGestureHandler", "TapGestureHandler"]), ("Mobile Storage", ["AsyncStorage", "SecureStore"]),
    ("Permission Handling", ["Permissions.", "requestPermission"]), ("Push Notifications", ["Notifications.", "registerForPushNotifications"]),
    ("Media/Camera Access", ["Camera", "ImagePicker"]), ("Location Services", ["Location.", "getCurrentPosition"]),
    ("Native Modules", ["NativeModules.", "NativeEventEmitter", "requireNativeComponent"]), ("Deep Linking", ["Linking.", "getInitialURL"]),
]


def pattern_names(content) -> "F.Column":
    seen = [F.when(paths.any_contains(content, words), F.lit(name)) for name, words in PROJECT_PATTERNS]
    seen.append(F.when(content.contains("async") & content.contains("await"), F.lit("Async/Await")))
    return F.array_compact(F.array(*seen))


def pack_patterns(packed: DataFrame, files: DataFrame) -> DataFrame:
    """Patterns in the files of each pack, one row per task and pattern."""
    named = files.select("project", "path", F.explode(pattern_names(F.col("content"))).alias("pattern"))
    return packed.select("project", "task_id", "path").distinct().join(named, ["project", "path"]).groupBy(
        "project", "task_id", "pattern").agg(F.count(F.lit(1)).alias("files"))
