"""The run: texts in, sentences out, by one row-wise plan that the options shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, ascii_fold_c1, control_chars, formfeed, normalize_eol, regularize_ws, split_dashes, sub
from ..operators.dictionaries import phrase_pattern, phrases_joined
from ..operators.lines import bullets_emitted, dehyphenated, noise_filtered
from ..operators.markup import tags_blanked, tags_hidden, tags_shown
from ..operators.segment import Dictionary, dictionary_map, paragraphs_of, sentence_tokens, sentences_of
from ..options import Options
from ..session import ship
from ..sources.readers import format_of, list_file, read_texts
from ..sources.rtf import rtf_text
from ..sources.sinks import encoded, with_eol


def prepared(df: DataFrame, key: str, o: Options) -> DataFrame:
    """key, text, original, is_rtf: format, line, bullet and markup stages."""
    ship(df.sparkSession)
    is_rtf = F.lit(False) if o.input_format == "text" else F.lit(True) if o.input_format == "rtf" else F.coalesce(format_of(F.col("text")) == "rtf", F.lit(False))
    t = df.select(key, F.col("text"), F.col("text").alias("original"), is_rtf.alias("is_rtf"))
    if o.input_format != "text":
        # only RTF documents reach Python; the others pass as nulls
        t = t.withColumn("text", F.when(F.col("is_rtf"), rtf_text(F.when(F.col("is_rtf"), F.col("text")))).otherwise(F.col("text")))
    stages = [normalize_eol]
    if o.suppress_markup:
        stages.append(lambda c: tags_blanked(c, o.markup or "html"))
    elif o.markup:
        stages.append(lambda c: tags_hidden(c, o.markup, o.tokenize))
    if o.unwrap_words:
        stages.append(dehyphenated)
    stages.append(control_chars)
    for f in stages:
        t = t.withColumn("text", f(F.col("text")))
    carried = F.struct(key, "original", "is_rtf").alias("k")
    back = lambda d: d.select(F.col(f"k.{key}").alias(key), "text", F.col("k.original").alias("original"), F.col("k.is_rtf").alias("is_rtf"))
    if o.suppress_noise:
        t = back(noise_filtered(t.select(carried, "text"), "k", o.noise_limit))
    if o.bullet_mode != "keep" or o.separate_bullets:
        t = back(bullets_emitted(t.select(carried, "text"), "k", o.bullet_mode, o.bullet_char, o.separate_bullets))
    return t


def _line(sentence: Column, o: Options, d: Dictionary | None, phrases: str | None) -> Column:
    """One output line of a sentence, without leading, trailing and repeated white space."""
    if o.tokenize:
        sentence = F.array_join(sentence_tokens(sentence, o.penn_treebank, d), o.token_split)
    else:
        sentence = F.when(sentence.contains("--"), split_dashes(sentence)).otherwise(sentence)
    if o.ascii_fold:
        sentence = F.when(F.col("is_rtf"), ascii_fold_c1(sentence)).otherwise(ascii_fold(sentence))
    line = phrases_joined(regularize_ws(sentence), phrases)
    return tags_shown(line) if o.markup and not o.suppress_markup else line


def run(df: DataFrame, key: str = "doc_id", options: Options = Options(), abbreviations: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """df(key, text) -> key, para_no, sent_no, sentence. No shuffle; usable on a stream."""
    o = options
    d, ph = dictionary_map(abbreviations), phrase_pattern(phrases)
    t = prepared(df, key, o)
    tags = bool(o.markup) and not o.suppress_markup
    per_para = F.transform(
        paragraphs_of(formfeed(F.col("text"))),
        lambda p, i: F.transform(sentences_of(p, d, tags), lambda s: F.struct(i.cast("bigint").alias("para_no"), s.alias("sentence"))),
    )
    lines = t.select(key, F.filter(F.transform(F.flatten(per_para), lambda x: F.struct(x["para_no"].alias("para_no"), _line(x["sentence"], o, d, ph).alias("sentence"))), lambda x: x["sentence"] != "").alias("xs"))
    s = lines.select(key, F.posexplode("xs").alias("sent_no", "x"))
    return s.select(key, F.col("x.para_no").alias("para_no"), F.col("sent_no").cast("bigint").alias("sent_no"), F.col("x.sentence").alias("sentence"))


def run_text(df: DataFrame, key: str = "doc_id", options: Options = Options(), abbreviations: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """df(key, text) -> key, text, content: the whole output of each document and its bytes in the output encoding. Row-wise."""
    o = options
    d, ph = dictionary_map(abbreviations), phrase_pattern(phrases)
    t = prepared(df, key, o)
    tags = bool(o.markup) and not o.suppress_markup
    end = " \n" if o.trailing_space else "\n"

    def shown(line: Column) -> Column:
        if o.blank_after_unpunctuated or o.blank_unless_punct:
            return F.when(line.rlike(r"[.;?!]\z"), F.concat(line, F.lit(end))).otherwise(F.concat(line, F.lit(end + "\n")))
        return F.concat(line, F.lit(end))

    paras = F.transform(paragraphs_of(formfeed(F.col("text"))), lambda p: F.array_join(F.transform(F.transform(sentences_of(p, d, tags), lambda s: _line(s, o, d, ph)), shown), ""))
    gap = "\n" if o.blank_at_paragraph_end else ""
    out = sub(F.array_join(paras, gap), r"\n{3,}", "\n\n")
    if o.keep_eol:
        out = with_eol(out, F.col("original"))
    return t.select(key, out.alias("text")).select(key, "text", encoded(F.col("text"), o.output_encoding).alias("content"))


def run_files(spark: SparkSession, options: Options) -> DataFrame:
    """What a command line asks for: the files of its input path, with its lists -> path, text, content."""
    if not options.input_path:
        raise ValueError("no input path")
    abbr = phrases = None
    if options.abbreviation_file:
        abbr = list_file(spark, options.abbreviation_file).select(F.col("entry").alias("abbr"), F.col("flagged").alias("expect_cap"))
    if options.phrase_file:
        phrases = list_file(spark, options.phrase_file).select(F.col("entry").alias("phrase"))
    # texts of RTF files are read as they are; the run turns them into text
    return run_text(read_texts(spark, options.input_path, "text"), "path", options, abbr, phrases)
