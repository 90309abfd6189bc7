"""Clients that tests name by import path; they run in Spark's workers."""

from __future__ import annotations


class Bank:
    def __init__(self, config: dict) -> None:
        self.config = config

    def transactions(self, date_from: str | None) -> dict:
        if self.config.get("broken"):
            raise ConnectionError("no answer")
        rows = [
            {"transactionId": "a1", "bookingDate": "2024-03-01", "transactionAmount": {"amount": "-4.50", "currency": "EUR"}, "creditorName": "Cafe"},
            {"bookingDate": "2024-03-02", "transactionAmount": {"amount": "12.00", "currency": "EUR"}, "remittanceInformationUnstructured": "RENT"},
        ]
        return {"transactions": {"booked": [r for r in rows if not date_from or r["bookingDate"] >= date_from], "pending": [{}]}}


    def _checked(self) -> None:
        if self.config.get("broken"):
            raise ConnectionError("no answer")

    def details(self, key: str) -> dict:
        self._checked()
        return {"account": {"resourceId": f"r{key}", "iban": f"DE{key}", "currency": "EUR"}}

    def balances(self, key: str) -> dict:
        self._checked()
        return {"balances": [{"balanceAmount": {"amount": "5.5", "currency": "EUR"}}]}

    def institutions(self, country: str) -> list[dict]:
        return [{"id": f"b-{country}", "name": "B", "countries": [country]}, {"id": "both", "name": "B", "countries": ["DE", "FR"]}]

    def rates(self, base: str) -> dict:
        return {"base_code": base, "conversion_rates": {"EUR": 0.9}}


class Categories:
    def category(self, names: list[str], transaction: dict) -> str:
        return {"C0": "food", "C1": "rent"}.get(transaction["creditor_name"], "unheard of")


class Enrichment:
    def merchant(self, request: dict) -> dict | None:
        if "boom" in request["description"]:
            raise TimeoutError
        return {"name": "Cafe Uno", "website": "https://cafe.example", "external_id": "m-1"} if "Cafe" in request["description"] else None


class Budget:
    def __init__(self, settings: dict) -> None:
        self.settings = settings

    def post(self, body: dict) -> list[str]:
        row = body["transactions"][0]
        return ["refused"] if row["payee"] == "Refused" else []
