import pytest

from velumen.functions import argon2
from velumen.operators import auth

#: The examples of RFC 9106, sections 5.1 to 5.3.
TAGS = {
    "argon2d": "512b391b6f1162975371d30919734294f868e3be3984f3c1a13a4db9fabe4acb",
    "argon2i": "c814d9d1dc7f37aa13f0d77f2494bda1c8de6b016dd388d29952a4c4672b6ce8",
    "argon2id": "0d640df58d78766c08c037a34a8b53c9d01ef0452d75b65eb52520e96b01e659",
}


@pytest.mark.parametrize("kind", sorted(TAGS))
def test_examples_of_the_standard(kind):
    got = argon2.digest(kind, b"\x01" * 32, b"\x02" * 16, memory=32, passes=3, lanes=4, size=32, secret=b"\x03" * 8, data=b"\x04" * 12)
    assert got.hex() == TAGS[kind]


def test_text_form():
    stored = argon2.encoded("argon2id", "pässword", b"0123456789abcdef", memory=64, passes=2, lanes=2, size=80)
    assert argon2.verify(stored, "pässword") and not argon2.verify(stored, "password")
    assert auth.verify_password(stored, "pässword") and not auth.verify_password(stored, "")
    assert auth.verify_password(auth.hash_password("x"), "x") and not auth.verify_password(auth.hash_password("x"), "y")
    for odd in ("", "$argon2id$v=19$m=64", stored.replace("v=19", "v=16"), stored.replace("argon2id", "argon2x"), stored.replace("m=64", "m=4"), stored.replace("m=64", "m=x")):
        assert not auth.verify_password(odd, "pässword")


def test_login_with_a_stored_hash(spark):
    stored = argon2.encoded("argon2id", "right", b"0123456789abcdef", memory=64, passes=1, lanes=1)
    users = spark.createDataFrame([(1, "ann", stored)], "id int, username string, password_hash string")
    assert auth.login(users, "ann", "right")[0] == "success" and auth.login(users, "ann", "wrong")[0] == "passwordIncorrect"
    assert auth.login(users, "bob", "right")[0] == "usernameNotFound"
