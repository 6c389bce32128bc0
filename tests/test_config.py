import subprocess

import pytest

from branchline import config, gitinfo
from branchline.errors import ConfigError
from branchline.naming import apart_from, ref_name


def load(tmp_path, text, environ=None, **more):
    (tmp_path / config.FILE).write_text(text)
    return config.load(tmp_path, environ=environ or {}, **more)


def test_precedence(tmp_path):
    text = "branching: {ttl_days: 1}\nprofiles: {p: {branching: {ttl_days: 2}}}\n"
    env = {"BRANCHLINE_BRANCHING__TTL_DAYS": "3", "BRANCHLINE_CHANGE_SET": "x"}
    assert load(tmp_path, text).branching.ttl_days == 1
    assert load(tmp_path, text, profile="p").branching.ttl_days == 2
    assert load(tmp_path, text, env, profile="p").branching.ttl_days == 3
    assert load(tmp_path, text, env, profile="p", overrides={"branching": {"ttl_days": 4}}).branching.ttl_days == 4


def test_variables_and_errors(tmp_path):
    assert load(tmp_path, "state: {store: postgres, uri: '${PG}'}", {"PG": "postgres://x"}).state.uri == "postgres://x"
    for bad in ("state: {uri: '${NOPE}'}", "state: {store: postgres}", "warehouse: {catalog: {type: nope}}", "warehouse: {catalog: {type: rest}}", "- a", "a: ["):
        with pytest.raises(ConfigError) as e:
            load(tmp_path, bad)
        assert e.value.status == 2
    with pytest.raises(ConfigError):
        config.load(tmp_path / "none", environ={})


def test_secrets():
    config.refuse_secrets({"a": {"password": "${PW}"}})
    with pytest.raises(ConfigError):
        config.refuse_secrets({"a": [{"access_key": "abc"}]})


def test_names():
    assert ref_name("feature/a b--c") == "feature_a_b_c" and ref_name("//") == "unnamed" and len(ref_name("x" * 999)) == 255
    assert apart_from("a", {"b"}) == "a" and apart_from("a", {"a"}, "me").startswith("a__me")
    first = apart_from("a", {"a"}, "me")
    assert apart_from("a", {"a", first}, "me") not in ("a", first) and apart_from("a", {"a"}, "you") != first
    long = "x" * 255
    assert len(apart_from(long, {long}, "me")) == 255 and "__me" in apart_from(long, {long}, "me")


def test_nested_settings():
    tree = {"a": {"b": [1, {"c": "${X}"}, []], "d": {}}, "e": None}
    assert config.planted(config.leaves(tree)) == tree and config.planted(config.leaves({})) == {}
    assert config.with_variables(tree, {"X": "y"})["a"]["b"][1] == {"c": "y"}
    assert config.from_environment({"BRANCHLINE_A__B": "1", "BRANCHLINE_A__C__D": "[x]", "BRANCHLINE_PROFILE": "p", "OTHER__A": "2"}) == {"a": {"b": 1, "c": {"d": ["x"]}}}
    with pytest.raises(ConfigError):
        config.refuse_secrets({"tokens": ["in clear"]})


def test_profile_of_the_environment(tmp_path):
    text = "branching: {ttl_days: 1}\nprofiles: {p: {branching: {ttl_days: 2}}, q: {branching: {ttl_days: 5}}}\n"
    assert load(tmp_path, text, {"BRANCHLINE_PROFILE": "p"}).branching.ttl_days == 2
    assert load(tmp_path, text, {"BRANCHLINE_PROFILE": "p"}, profile="q").branching.ttl_days == 5


def test_git(tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)

    git("init", "-b", "main")
    (tmp_path / "a.sql").write_text("one")
    git("add", ".")
    git("commit", "-m", "m")
    git("checkout", "-b", "work")
    (tmp_path / "a.sql").write_text("two")
    assert gitinfo.branch_of(tmp_path) == "work" and gitinfo.uncommitted(tmp_path) == ["a.sql"]
    assert gitinfo.file_at(tmp_path, gitinfo.fork_point(tmp_path), "a.sql") == "one"
    assert gitinfo.root_of(tmp_path.parent / "nowhere") is None
