"""Secrets behind wide columns, long names, long chains and long joins."""

from rasterloom.llm import secret_scan

LITERAL = "s3cr3tValue99"


def test_any_run_of_blanks_before_the_operator():
    for blanks in (1, 4, 5, 6, 40):
        for gap in (" ", "\t"):
            text = f'db_pass{gap * blanks}= "{LITERAL}"'
            assert secret_scan.redact(text) == text.replace(LITERAL, "[SECRET]")


def test_names_of_any_length():
    name = "password_" + "x" * 200
    assert LITERAL not in secret_scan.redact(f'{name} = "{LITERAL}"')


def test_long_chains_in_reverse_order():
    chain = ["db_pass = v0"] + [f"v{i} = v{i + 1}" for i in range(40)] + [f'v40 = "{LITERAL}"']
    assert LITERAL not in secret_scan.redact("\n".join(chain))
    assert LITERAL not in secret_scan.redact("\n".join(reversed(chain)))
    assert LITERAL in secret_scan.redact("\n".join(chain[1:]).replace("v", "w"))


def test_cycles_and_doubling_names_end():
    assert LITERAL not in secret_scan.redact(f'db_pass = a\na = b + "{LITERAL}"\nb = a')
    doubled = ["db_pass = v0"] + [f"v{i} = v{i + 1} + v{i + 1}" for i in range(60)] + [f'v60 = "{LITERAL}"']
    assert LITERAL not in secret_scan.redact("\n".join(doubled))


def test_all_joined_literals():
    literals = [f"s3cr3tValue{i:02d}" for i in range(30)]
    clean = secret_scan.redact("db_pass = " + " + ".join(f'"{x}"' for x in literals))
    assert not any(x in clean for x in literals)


def test_later_values_of_a_name_do_not_reach_back():
    text = f'x = "{LITERAL}"\ndb_pass = x\nx = "0th3rValue77"'
    assert secret_scan.redact(text) == text.replace(LITERAL, "[SECRET]")
