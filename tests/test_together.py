"""Models that do not wait for each other are written at the same time, and each one once."""

import threading
import time

import pytest

from bazarlytics.plans.warehouse import Warehouse
from bazarlytics.quality import checks


class Noted(Warehouse):
    """Writes that only end when the two staging models are being written at the same time."""

    def __init__(self, spark):
        super().__init__(spark, {})
        self.met, self.written = threading.Barrier(2), []

    def _write(self, name):
        self.written.append(name)
        if name == "fct_payments":
            return [self["stg_orders"], self["stg_payments"]]
        self.met.wait(20)
        time.sleep(0.2)
        return name


def test_checks_have_independent_tables_written_together(spark):
    shop = Noted(spark)
    chosen = [
        checks.not_null("stg_orders", "order_id"),
        checks.relationships("stg_payments", "order_id", "stg_orders", "order_id"),
        checks.Check("rule", "fct_payments", rows=lambda t: t["fct_payments"]),
    ]
    checks._gather(chosen, shop)
    assert sorted(shop.written) == ["fct_payments", "stg_orders", "stg_payments"]
    assert shop["fct_payments"] == ["stg_orders", "stg_payments"]
    assert shop.seconds["fct_payments"] < 0.2 <= shop.seconds["stg_orders"]


def test_a_failing_write_reaches_the_caller(spark):
    shop = Noted(spark)
    shop._write = lambda name: 1 / 0
    with pytest.raises(ZeroDivisionError):
        checks._gather([checks.not_null("stg_orders", "order_id")], shop)
