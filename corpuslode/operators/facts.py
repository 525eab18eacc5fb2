"""Facts per file, derived once and shared by every job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths, text


def with_code(files: DataFrame) -> DataFrame:
    """Add ``code``: the content without comments."""
    return files.withColumn("code", text.code_text(F.col("content")))


def with_imports(files: DataFrame) -> DataFrame:
    """Add ``imports`` (structs) and ``import_sources`` from the code text."""
    if "code" not in files.columns:
        files = with_code(files)
    return files.withColumn("imports", text.extract_imports(F.col("code"))).withColumn(
        "import_sources", F.col("imports")["source"]
    )


def import_rows(files: DataFrame) -> DataFrame:
    """One row per import declaration, in file order."""
    return (
        with_imports(files)
        .select("project", "path", F.posexplode_outer("imports").alias("position", "import"))
        .filter("import IS NOT NULL")
        .select("project", "path", "position", F.col("import.source").alias("source"),
                F.col("import.specifiers").alias("specifiers"))
    )


def file_facts(files: DataFrame, compat: bool = False) -> DataFrame:
    """Lines, tokens, complexity, imports, exports and path classes of each file.

    The text is dropped here, so what later jobs shuffle is a few hundred bytes
    per file whatever the size of the file.
    """
    content, path = F.col("content"), F.col("path")
    keep = [c for c in ("project", "path", "framework") if c in files.columns]
    return (
        with_imports(files)
        .withColumn("bare", text.bare_text(content))
        .select(
            *keep,
            text.line_count(content).alias("lines"),
            F.length(content).alias("chars"),
            text.est_tokens(content).alias("tokens"),
            text.complexity(F.col("bare"), compat).alias("complexity"),
            "imports",
            "import_sources",
            text.extract_exports(F.col("code")).alias("exports"),
            paths.classify_file(path).alias("file_class"),
            paths.infer_purpose(path).alias("purpose"),
            paths.is_security_path(path).alias("security_related"),
        )
    )


# What shows navigation, animation and storage use.
NAVIGATION_SOURCES = (["expo-router"], ["@react-navigation/", "expo-router/"])
ANIMATION_SOURCES = ["react-native-reanimated", "react-native-animatable", "lottie-react-native"]
STORAGE_SOURCES = [
    "@react-native-async-storage/async-storage", "@react-native-community/async-storage", "expo-secure-store",
]
NAVIGATION_NAMES = r"\b(useNavigation|useRoute|useFocusEffect|useIsFocused|useNavigationState|useScrollToTop)\b"


def file_flags(files: DataFrame) -> DataFrame:
    """Framework flags of each file, from its imports and identifiers."""
    df = with_imports(files)
    sources, code = F.col("import_sources"), F.col("code")

    def starts(*prefixes):
        return F.exists(sources, lambda s: _any([s.startswith(p) for p in prefixes]))

    def equals(*names):
        return F.arrays_overlap(sources, F.array(*[F.lit(n) for n in names]))

    react, native = equals("react"), equals("react-native")
    vue_file = F.col("path").endswith(".vue")
    vue = equals("vue") | starts("@vue/")
    mobile = native | starts("expo")
    hooky = code.rlike(r"\buse\w*")
    animated = F.exists(
        F.col("imports"),
        lambda i: (i["source"] == "react-native") & F.exists(i["specifiers"], lambda s: s.contains("Animated")),
    )
    return df.select(
        "project",
        "path",
        (react | native).alias("is_react"),
        (vue | vue_file).alias("is_vue"),
        mobile.alias("is_react_native"),
        (hooky & (react | native)).alias("has_hooks"),
        (vue_file | (hooky & vue)).alias("has_composables"),
        (mobile & (equals(*NAVIGATION_SOURCES[0]) | starts(*NAVIGATION_SOURCES[1]))).alias("has_navigation"),
        (mobile & (equals(*ANIMATION_SOURCES) | animated)).alias("has_animations"),
        (mobile & equals(*STORAGE_SOURCES)).alias("has_async_storage"),
        (mobile & code.rlike(r"\bPlatform\.(OS|select|Version)\b")).alias("has_platform_code"),
        (mobile & code.rlike(r"\b(NativeModules|NativeEventEmitter)\.")).alias("has_native_modules"),
        F.when(mobile, F.size(F.regexp_extract_all(code, F.lit(NAVIGATION_NAMES), F.lit(1)))).otherwise(0).alias("navigation_hooks"),
    )


def _any(tests):
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out
