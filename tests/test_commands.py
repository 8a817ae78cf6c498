"""Shell words against the standard library's lexer, and labels of wrapped commands."""

import random
import shlex

from runloom.operators import commands

CASES = {
    "python -": "python", "python3 - <<'EOF'\nprint(1)\nEOF": "python3", "python -u -": "python", "bash -c 'python -'": "python", "python -c 'print(1)'": "python", "python -m pytest -q": "pytest",
    "python scripts/run.py --flag": "run.py", "python": "python", "cd src && git status": "git", "cd /x": "cd", "cd a; cd b": "", 'echo "a; b" | grep "x y"': "echo", "FOO='a b' BAR=1 make -j": "make",
    "sudo -u 'my user' env -i A=1 nice -n 5 rg foo": "rg", "timeout -k 5 30s pytest": "pytest", "timeout /t 5": "timeout", "sh -lc \"cd x && FOO=1 find . -name '*.py'\"": "find", "bash script.sh": "bash",
    "command -v node": "command", "if ! grep -q x y; then echo; fi": "grep", "C:\\Python\\python.exe tools\\run.py": "run.py", "cmd /c dir": "dir", "bash -c \"bash -c 'bash -c \\\"ls\\\"'\"": "ls",
    "git -C dir grep x": "git", "echo 'it'\\''s'": "echo", "A=1 oops 'open": "oops", "  ": "", "xargs -n 1 fgrep x": "fgrep", "python -W ignore -X dev a/b.py": "b.py", "'my tool' x": "my tool", "''": "", "pypy3.9 -- run.py": "run.py",
}
SEARCHES = {'echo "a; b" | grep "x y"', "sudo -u 'my user' env -i A=1 nice -n 5 rg foo", "sh -lc \"cd x && FOO=1 find . -name '*.py'\"", "if ! grep -q x y; then echo; fi", "git -C dir grep x", "xargs -n 1 fgrep x"}


def test_labels_and_searches(spark):
    names = list(CASES)
    df = spark.createDataFrame(list(enumerate(names + names[:3])), "command_id long, command string")
    got = {r["command_id"]: (r["label"], r["searches"]) for r in commands.labels(df).collect()}
    assert len(got) == len(names) + 3
    for i, name in enumerate(names):
        assert got[i] == (CASES[name], name in SEARCHES), name


def segments(command):
    lexer = shlex.shlex(command, posix=True, punctuation_chars=";&|()\n")
    lexer.whitespace, lexer.whitespace_split, lexer.commenters = " \t\r", True, ""
    try:
        tokens = list(lexer)
    except ValueError:
        return []
    found = [[]]
    for token in tokens:
        if token and set(token) <= set(";&|()\n"):
            found.append([])
        else:
            found[-1].append(token)
    return [s for s in found if s]


def test_words_are_those_of_a_shell(spark, monkeypatch):
    from runloom.operators import slices

    monkeypatch.setattr(slices.with_slice, "__defaults__", (5, "step_idx"))
    rnd = random.Random(2)
    pieces = ["a", "bc", " ", "  ", "'", '"', "\\", ";", "&&", "|", "\n", "(", ")", "x=1", "'q r'", '"d \\" e"', "\t", "é", "$x", "''"]
    lines = ["".join(rnd.choices(pieces, k=rnd.randrange(1, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "command_id long, command string")
    got = {}
    for r in commands.words(df).collect():
        got.setdefault(r["command_id"], []).append((r["segment"], r["tokens"]))
    for i, line in enumerate(lines):
        # the library takes a quoted word of punctuation only for punctuation
        mine = [t for _, t in sorted(got.get(i, []))]
        if any(t and set(t) <= set(";&|()\n") for s in mine for t in s):
            continue
        assert mine == segments(line), line
