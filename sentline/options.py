"""Options of a run: one immutable record that the plan is built from, its option file and its command line."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """All settings are literals in the plan, so a part that is switched off is not in it."""

    input_format: str = "auto"  # auto, text or rtf
    output_encoding: str = "utf-8"  # utf-8, utf-16 or iso-8859-1
    tokenize: bool = False
    penn_treebank: bool = False
    token_split: str = " "
    unwrap_words: bool = True
    suppress_noise: bool = False
    suppress_markup: bool = False
    markup: str | None = None  # xml or html
    ascii_fold: bool = False
    bullet_mode: str = "keep"  # keep, replace or drop
    bullet_char: str = "*"
    separate_bullets: bool = False
    blank_after_unpunctuated: bool = False
    blank_unless_punct: bool = False
    blank_at_paragraph_end: bool = False
    keep_eol: bool = False
    trailing_space: bool = False
    noise_limit: float = 0.44
    abbreviation_file: str | None = None  # list files and input of a command line; run_files reads them
    phrase_file: str | None = None
    input_path: str | None = None

    def updated(self, **changes: object) -> Options:
        return replace(self, **changes)


# Option letters, the setting that each changes and the value it puts there (None: its argument).
LETTERS = {
    "t": ("tokenize", True), "P": ("penn_treebank", True), "A": ("ascii_fold", True), "n": ("suppress_noise", True), "h": ("suppress_markup", True), "w": ("unwrap_words", True),
    "e": ("blank_after_unpunctuated", True), "E": ("blank_unless_punct", True), "p": ("blank_at_paragraph_end", True), "k": ("keep_eol", True), "S": ("trailing_space", True),
    "D": ("token_split", "\x7f"), "B": ("bullet_char", None), "b": ("separate_bullets", True), "x": ("input_format", None), "o": ("output_encoding", None), "M": ("markup", None),
    "a": ("abbreviation_file", None), "m": ("phrase_file", None), "i": ("input_path", None),
}


def split_option_line(line: str) -> tuple[str, str] | None:
    """(letter, value) of an option line; null for blank lines, comments and lines that hold no option.

    Quotes around a value come off if only blanks or a comment follow; else a comment ends the value."""
    line = line.strip()
    if len(line) < 2 or line[0] != "-" or not line[1].isalpha():
        return None
    value = line[2:].strip()
    if value[:1] in ('"', "'") and (end := value.find(value[0], 1)) > 0 and (not (rest := value[end + 1 :].strip()) or rest.startswith(";")):
        return line[1], value[1:end]
    return line[1], value.split(";", 1)[0].rstrip()


def with_option(base: Options, letter: str, value: str) -> Options:
    """One option applied. An unknown letter, a missing argument or one where none belongs is an error; '-' switches off."""
    if letter not in LETTERS:
        raise ValueError(f"unknown option: -{letter}")
    name, fixed = LETTERS[letter]
    if fixed is None:
        if not value:
            raise ValueError(f"option without argument: -{letter}")
        return base.updated(**{name: value}, **({"bullet_mode": "replace"} if name == "bullet_char" else {}))
    if value == "-" and isinstance(fixed, bool):
        return base.updated(**{name: False})
    if value:
        raise ValueError(f"option takes no argument: -{letter} {value}")
    return base.updated(**{name: fixed})


def parse_option_lines(lines: list[str], base: Options = Options()) -> Options:
    """Settings of an option file: '-x value' lines; ';' starts a comment line; a line that is neither is an error."""
    for line in lines:
        found = split_option_line(line)
        if found is not None:
            base = with_option(base, *found)
        elif line.strip() and not line.strip().startswith(";"):
            raise ValueError(f"no option letter: {line.strip()!r}")
    return base


def parse_arguments(argv: list[str], base: Options = Options()) -> Options:
    """Settings of a command line: letters after '-' or '/', their value attached or next, '--' alone ends them; and each
    setting by its long name. What follows the options is the input path."""
    flags = {"--" + f.name.replace("_", "-"): f for f in fields(Options)}
    rest = list(argv)
    while rest:
        arg = rest.pop(0)
        if arg == "--":
            break
        name, eq, given = arg.partition("=")
        off = name.startswith("--no-")
        flag = flags.get("--" + name[5:] if off else name)
        if flag is not None and isinstance(flag.default, bool):
            base = base.updated(**{flag.name: not off})
        elif flag is not None:
            if not eq and not rest:
                raise ValueError(f"option without argument: {arg}")
            value = given if eq else rest.pop(0)
            base = base.updated(**{flag.name: float(value) if isinstance(flag.default, float) else value})
        elif len(arg) > 1 and (arg[0] == "-" or arg[0] == "/" and arg[1] in LETTERS and (len(arg) == 2 or LETTERS[arg[1]][1] is None)) and arg[1] != "-":
            letter, value = arg[1], arg[2:]
            if not value and letter in LETTERS and LETTERS[letter][1] is None and rest and not (rest[0].startswith("-") and len(rest[0]) > 1):
                value = rest.pop(0)
            base = with_option(base, letter, value)
        elif arg.startswith("--"):
            raise ValueError(f"unknown option: {arg}")
        else:
            rest.insert(0, arg)
            break
    return base.updated(input_path=rest[0]) if rest else base
