"""Shell commands as tokens: words, what is read and written by redirection, and the files that each command writes, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN, _SINGLE, _DOUBLE, _ESCAPED, _ESCAPED_IN_DOUBLE, _COMMENT = range(6)
#: Words before the one that names the command.
_BEFORE = r"^([A-Za-z_]\w*=.*|sudo|env|nohup|time|exec|command|builtin|nice|xargs|-.*)$"
#: Tools that reach other machines.
NETWORK = ["curl", "wget", "nc", "ncat", "scp", "sftp", "rsync", "ftp", "ssh"]
#: What names a file of secrets, and places where no command may write.
SECRET = r"(^|[^\w])\.env\b|\bid_(rsa|dsa|ecdsa|ed25519)\b|\bcredentials\b"
SENSITIVE = r"^(/(etc|usr|bin|sbin|lib|boot|sys|proc)(/|$)|~/\.(ssh|aws|gnupg|kube|docker)(/|$)|~/\.(bashrc|bash_profile|profile|zshrc|zprofile|zshenv|netrc)$)"
_DEVICE = r"^/dev/(null|stdout|stderr|tty|fd/\d+)$"
#: A line of words, few of them in quotes, and pipes, with nothing that is escaped, redirected, left out or open; its tokens; what is in quotes.
_SIMPLE = r"\A(?!\z)[^'\"\\#<>;&()`\n]*+(?:(?:'[^'\\#<>;&()`\n]*+'|\"[^\"\\#<>;&()`\n]*+\")[^'\"\\#<>;&()`\n]*+){0,20}\z"
_TOKEN, _QUOTES = r"\||(?:[^ \t\r|'\"]++|'[^']*+'|\"[^\"]*+\")+", r"'([^']*)'|\"([^\"]*)\""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(command: Column) -> Column:
    """The shell's tokens, as an array of (op, text): op is word, or one of ; | & ( ) < > and the line end. Quotes and escapes are resolved, comments left out, and a number before a redirection is part of it.

    A simple line is cut by a pattern, which gives the same tokens; others are read character by character.
    """
    piped = lambda t: F.struct(F.when(t == "|", "|").otherwise("word").alias("op"), F.when(t == "|", "").otherwise(F.regexp_replace(t, _QUOTES, "$1$2")).alias("text"))
    return F.when(command.rlike(_SIMPLE), F.transform(F.regexp_extract_all(command, F.lit(_TOKEN), 0), piped)).otherwise(read_tokens(command))


def read_tokens(command: Column) -> Column:
    """tokens, read character by character."""
    state = lambda mode, open_, word, out: F.struct(F.lit(mode).alias("mode"), F.lit(open_).alias("open") if isinstance(open_, bool) else open_.alias("open"), word.alias("word"), out.alias("out"))
    token = lambda op, text: F.struct(op.alias("op"), text.alias("text"))
    blank = F.lit("")

    def step(s: Column, c: Column) -> Column:
        word, out = s["word"], s["out"]
        flushed = F.when(s["open"], F.array_append(out, token(F.lit("word"), word))).otherwise(out)
        longer = F.concat(word, c)
        number = s["open"] & word.rlike(r"^\d+$")
        plain = (
            F.when(c.isin(" ", "\t", "\r"), state(_PLAIN, False, blank, flushed))
            .when(c == "'", state(_SINGLE, True, word, out))
            .when(c == '"', state(_DOUBLE, True, word, out))
            .when(c == "\\", state(_ESCAPED, s["open"], word, out))
            .when((c == "#") & ~s["open"], state(_COMMENT, False, blank, out))
            .when(c.isin("<", ">"), state(_PLAIN, False, blank, F.array_append(F.when(number, out).otherwise(flushed), token(c, blank))))
            .when(c.isin(";", "|", "&", "(", ")", "\n", "`"), state(_PLAIN, False, blank, F.array_append(flushed, token(c, blank))))
            .otherwise(state(_PLAIN, True, longer, out))
        )
        return (
            F.when(s["mode"] == _PLAIN, plain)
            .when(s["mode"] == _SINGLE, F.when(c == "'", state(_PLAIN, True, word, out)).otherwise(state(_SINGLE, True, longer, out)))
            .when(s["mode"] == _DOUBLE, F.when(c == '"', state(_PLAIN, True, word, out)).when(c == "\\", state(_ESCAPED_IN_DOUBLE, True, word, out)).otherwise(state(_DOUBLE, True, longer, out)))
            .when(s["mode"] == _ESCAPED, F.when(c == "\n", state(_PLAIN, s["open"], word, out)).otherwise(state(_PLAIN, True, longer, out)))
            .when(s["mode"] == _ESCAPED_IN_DOUBLE, state(_DOUBLE, True, F.when(c.isin('"', "\\", "$", "`"), longer).otherwise(F.concat(word, F.lit("\\"), c)), out))
            .otherwise(F.when(c == "\n", state(_PLAIN, False, blank, F.array_append(out, token(c, blank)))).otherwise(s))
        )

    none = F.array().cast("array<struct<op:string,text:string>>")
    return F.aggregate(F.split(command, ""), state(_PLAIN, False, blank, none), step, lambda s: F.when(s["open"], F.array_append(s["out"], token(F.lit("word"), s["word"]))).otherwise(s["out"]))


def placed(of: Column) -> Column:
    """tokens -> an array of (kind, text, pipeline, command): words, and the operands of redirections as write or read; commands of one pipeline are joined by |."""
    new = lambda s, pipeline, command, after, out: F.struct((s["pipeline"] + pipeline).alias("pipeline"), (s["command"] + command).alias("command"), F.lit(after).alias("after") if isinstance(after, str) else after.alias("after"), out.alias("out"))

    def step(s: Column, t: Column) -> Column:
        op, after, out = t["op"], s["after"], s["out"]
        kind = F.when(after == ">", "write").when(after == "<", "read").when(after == "<<", "text").when(after == ">&", F.when(t["text"].rlike(r"^(\d+|-)$"), "descriptor").otherwise("write")).otherwise("word")
        word = F.array_append(out, F.struct(kind.alias("kind"), t["text"].alias("text"), s["pipeline"].alias("pipeline"), s["command"].alias("command")))
        return (
            F.when(op == "word", new(s, 0, 0, "", word))
            .when((op == ">") & (after == "&"), new(s, -1, -1, ">", out))
            .when(op == ">", new(s, 0, 0, ">", out))
            .when(op == "<", new(s, 0, 0, F.when(after.isin("<", "<<"), "<<").otherwise("<"), out))
            .when((op == "&") & (after == ">"), new(s, 0, 0, ">&", out))
            .when((op == "|") & (after == ">"), s)
            .when((op == "&") & (after == "|"), new(s, 0, 0, "", out))
            .when((op == "|") & (after == "|"), new(s, 1, 0, "", out))
            .when(op == "|", new(s, 0, 1, "|", out))
            .when(op.isin("(", ")", "`"), new(s, 0, 1, "", out))
            .otherwise(new(s, 1, 1, F.when(op == "&", "&").otherwise(""), out))
        )

    none = F.array().cast("array<struct<kind:string,text:string,pipeline:int,command:int>>")
    start = F.struct(F.lit(0).alias("pipeline"), F.lit(0).alias("command"), F.lit("").alias("after"), none.alias("out"))
    return F.aggregate(of, start, step, lambda s: s["out"])


def commands(command: Column) -> Column:
    """An array of (pipeline, name, words, reads, writes): each command of a line with its words from its name on and all files that it writes.

    Written are the operands of > and >>, of tee, touch, truncate and mkdir, the last one of cp, mv, ln, install, scp and rsync
    or that of -t, dd's of=, what sed edits in place, and what curl -o and wget -O name.
    """

    def one(every: Column, i: Column) -> Column:
        own = F.filter(every, lambda t: t["command"] == i)
        pick = lambda kind: _picked(own, kind)
        return let(_from_name(pick("word")), lambda w: F.struct(F.get(own, F.lit(0))["pipeline"].alias("pipeline"), _name(w).alias("name"), w.alias("words"), pick("read").alias("reads"), F.concat(pick("write"), _written(w)).alias("writes")))

    return _each(command, one)


def words(command: Column) -> Column:
    """An array of (name, words) of each command of a line (see commands)."""
    return _each(command, lambda every, i: let(_from_name(_picked(F.filter(every, lambda t: t["command"] == i), "word")), lambda w: F.struct(_name(w).alias("name"), w.alias("words"))))


def _each(command: Column, one: Callable[[Column, Column], Column]) -> Column:
    """An array of one(all words and operands, command) for each command of a line."""
    return let(placed(tokens(command)), lambda every: F.transform(F.array_distinct(F.transform(every, lambda t: t["command"])), lambda i: one(every, i)))


def _picked(own: Column, kind: str) -> Column:
    return F.transform(F.filter(own, lambda t: t["kind"] == kind), lambda t: t["text"])


def _from_name(picked: Column) -> Column:
    return let(picked, lambda w: F.slice(w, F.greatest(F.array_position(F.transform(w, lambda x: ~x.rlike(_BEFORE)), F.lit(True)).cast("int"), F.lit(1)), F.greatest(F.size(w), F.lit(1))))


def _name(words: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.get(words, F.lit(0)), F.lit("")), "^.*/", "")


def _written(words: Column) -> Column:
    name = _name(words)
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    operands = F.filter(rest, lambda w: ~w.startswith("-"))
    none = F.array().cast("array<string>")
    after = lambda *flags: F.filter(F.zip_with(rest, F.array_append(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), F.lit(None).cast("string")), lambda a, b: F.when(a.isin(*flags), b)), lambda x: x.isNotNull())
    joined = lambda flag: F.transform(F.filter(rest, lambda w: w.startswith(flag)), lambda w: F.substring(w, F.lit(len(flag) + 1), F.char_length(w)))
    last = F.when(F.size(operands) > 1, F.slice(operands, -1, 1)).otherwise(none)
    edited = F.when(F.exists(rest, lambda w: w.rlike("^(-[a-zA-Z]*i.*|--in-place.*)$")), F.when(F.exists(rest, lambda w: w.rlike("^-[ef]$")), operands).otherwise(F.slice(operands, 2, F.greatest(F.size(operands) - 1, F.lit(0))))).otherwise(none)
    return (
        F.when(name.isin("cp", "mv", "ln", "install", "scp", "rsync"), F.concat(last, after("-t", "--target-directory"), joined("--target-directory=")))
        .when(name.isin("tee", "touch", "truncate", "mkdir"), operands)
        .when(name == "dd", joined("of="))
        .when(name == "sed", edited)
        .when(name == "curl", F.concat(after("-o", "--output"), joined("--output=")))
        .when(name == "wget", F.concat(after("-O", "--output-document"), joined("--output-document=")))
        .otherwise(none)
    )


def normal_path(path: Column) -> Column:
    """The path with home as ~, and without . and .. but for those that lead out of where it begins."""
    home = F.regexp_replace(path, r"^(\$HOME|\$\{HOME\}|/root|/home/[^/]+)(?=/|$)", "~")
    begin = F.when(home.startswith("/"), "/").otherwise("")
    step = lambda out, p: F.when(p.isin("", "."), out).when((p == "..") & (F.size(out) > 0) & ~F.coalesce(F.element_at(out, -1) == "..", F.lit(True)), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when((p == "..") & home.startswith("/"), out).otherwise(F.array_append(out, p))
    return F.concat(begin, F.array_join(F.aggregate(F.split(home, "/"), F.array().cast("array<string>"), step), "/"))


def outside(path: Column) -> Column:
    """Whether a path, as normal_path gives it, leaves the working folder; what a variable holds can't be known, so it does. Devices that keep nothing don't."""
    return path.rlike(r"^(/|~|\$|\.\.(/|$))") & ~path.rlike(_DEVICE) & ~path.rlike(r"^\$(PWD|\{PWD\})(/|$)")


def sensitive(path: Column) -> Column:
    """Whether a path, as normal_path gives it, is a place of the system or of its user's keys and start-up files."""
    return path.rlike(SENSITIVE)


def _flat(command: Column) -> Column:
    def rules(found: Column) -> Column:
        def deletes(c: Column) -> Column:
            def after(words: Column) -> Column:
                flags = F.filter(words, lambda w: w.startswith("-"))
                recursive = F.exists(flags, lambda w: w.rlike("^(-[a-zA-Z]*[rR][a-zA-Z]*|--recursive)$"))
                return recursive & F.exists(flags, lambda w: w.rlike("^(-[a-zA-Z]*f[a-zA-Z]*|--force)$"))

            at = F.array_position(F.transform(c["words"], lambda w: w.rlike("^(.*/)?rm$")), F.lit(True)).cast("int")
            return c["name"].isin("rm", "find") & (at > 0) & after(F.slice(c["words"], F.greatest(at, F.lit(1)), F.greatest(F.size(c["words"]), F.lit(1))))

        pushes = lambda c: (c["name"] == "git") & F.array_contains(c["words"], "push") & F.exists(c["words"], lambda w: w.rlike(r"^(--force.*|-[a-zA-Z]*f[a-zA-Z]*|\+.+)$"))
        secret = lambda words: F.exists(words, lambda w: w.rlike(SECRET))
        reads = lambda c: secret(F.filter(F.concat(c["words"], c["reads"]), lambda w: ~F.array_contains(c["writes"], F.regexp_replace(w, r"^(of|--[\w-]+)=", ""))))
        along = lambda test, c: F.exists(found, lambda d: (d["pipeline"] == c["pipeline"]) & test(d))
        sends = lambda c: c["name"].isin(*NETWORK) & along(lambda d: secret(F.concat(d["words"], d["reads"])), c)
        takes_out = lambda c: F.exists(c["writes"], lambda w: outside(normal_path(w))) & along(reads, c)
        spoils = lambda c: F.exists(c["writes"], lambda w: sensitive(normal_path(w)))
        told = [(deletes, "recursive forced delete"), (pushes, "forced push"), (sends, "secret sent out"), (takes_out, "secret written outside"), (spoils, "sensitive place")]
        return F.coalesce(*[F.when(F.exists(found, rule), F.lit(reason)) for rule, reason in told], F.lit(None).cast("string"))

    return let(commands(command), rules)


def denied(command: Column) -> Column:
    """Why a command is denied, null if it isn't: it deletes recursively and by force, pushes by force, gives a secret to a network tool, writes one outside the working folder, or writes to a sensitive place. What sh -c is given counts too."""
    scripts = F.transform(F.filter(commands(command), lambda c: c["name"].isin("sh", "bash", "zsh", "dash")), lambda c: F.get(c["words"], F.array_position(F.transform(c["words"], lambda w: w.rlike("^-[a-z]*c$")), F.lit(True)).cast("int")))
    inner = F.nullif(F.array_join(scripts, "\n"), F.lit(""))
    return F.coalesce(_flat(command), F.when(command.rlike(r"\b(sh|bash|zsh|dash)\b"), _flat(inner)))
