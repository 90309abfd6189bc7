"""Commands, end to end over a store."""

from __future__ import annotations

import json

import pytest

from coffer import cli
from coffer.operators.lookup import NotFound


def test_commands(spark, tmp_path):
    where = ["--store", str(tmp_path / "s"), "--json"]
    run = lambda *words: [json.loads(line) for line in cli.main([*where, *words], spark)]
    landed = tmp_path / "in"
    landed.mkdir()
    (landed / "1.json").write_text(json.dumps({"account": {"resourceId": "r1", "iban": "DE1", "currency": "EUR", "ownerName": "O"}}))
    assert run("users", "add", "--name", "Ann", "--email", "a@example.com")[0]["id"] == 1
    assert run("users", "list")[0]["name"] == "Ann"
    assert run("accounts", "add", "--landed", str(landed), "--institution", "B", "--user-id", "1")[0]["number"] == "DE1"
    run("functions", "add", "--name", "f", "--function-type", "budget", "--source", "", "--user-id", "1")
    params = json.dumps({"api_key": "k", "account_id": "42"})
    run("triggers", "add", "--event", "transaction_created", "--name", "t", "--filter", "[]", "--params", params, "--user-id", "1", "--function-id", "1")
    with pytest.raises(NotFound):
        run("triggers", "add", "--event", "e", "--name", "t", "--filter", "[]", "--params", "{}", "--user-id", "9", "--function-id", "1")
    assert run("transactions", "import", "--bank", "stubs:Bank", "--enricher", "stubs:Enrichment", "--client", "stubs:Budget") == [{"account_id": 1, "status": "ok", "n_new": 2}]
    listed = run("transactions", "list", "--search", "cafe")
    assert [(r["external_id"], r["merchant_name"]) for r in listed] == [("a1", "Cafe Uno")]
    assert len(run("transactions", "list", "--limit", "1")) == 1 and len(run("triggers", "log")) == 2
    assert {r["status"] for r in run("triggers", "log")} == {"ok"}
    assert run("triggers", "run", "--trigger-id", "1", "--client", "stubs:Budget") == []  # no predicates: nothing
    assert len(run("transactions", "create-trigger", "--transaction-id", "1", "--client", "stubs:Budget")) == 0  # done before
    assert len(run("transactions", "assign-merchants", "--enricher", "stubs:Enrichment")) == 1
    assert [r["name"] for r in run("merchants", "list")] == ["Cafe Uno"]
    rates = tmp_path / "rates"
    rates.mkdir()
    (rates / "usd.json").write_text(json.dumps({"base_code": "USD", "conversion_rates": {"EUR": 0.9, "XXQ": 1}}))
    run("rates", "update", "--landed", str(rates))
    assert [(r["code"], r["rate"]) for r in run("rates", "list")] == [("EUR", 0.9)]
    assert cli.main(["--store", str(tmp_path / "s"), "users", "list"], spark)[1].startswith("1 | Ann | a@example.com | ")


def test_landed_answers(spark, tmp_path):
    where = ["--store", str(tmp_path / "s"), "--json"]
    run = lambda *words: [json.loads(line) for line in cli.main([*where, *words], spark)]
    for name, body in (("details", {"account": {"resourceId": "r1", "iban": "DE1", "currency": "EUR", "ownerName": "O"}}), ("balances", {"balances": [{"balanceAmount": {"amount": "5.5", "currency": "EUR"}}]}), ("banks", [{"id": "i1", "name": "Bank", "countries": ["DE"]}, {"id": "i2", "name": "Other", "countries": ["FR"]}])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(json.dumps(body))
    run("users", "add", "--name", "Ann", "--email", "a@example.com")
    run("accounts", "add", "--landed", str(tmp_path / "details"), "--institution", "B", "--user-id", "1")
    assert run("accounts", "update-balances", "--landed", str(tmp_path / "balances")) == []
    assert run("accounts", "populate-details", "--landed", str(tmp_path / "details")) == []
    assert run("accounts", "relink", "--landed", str(tmp_path / "details"), "--institution", "B", "--user-id", "1") == []
    assert run("accounts", "list")[0]["balance"] == 5.5
    assert [r["id"] for r in run("institutions", "list", "--landed", str(tmp_path / "banks"), "--country", "DE")] == ["i1"]
    assert len(run("accounts", "fetch", "--bank", "stubs:Bank")) == 2
