import pytest

from quire.functions import formcalc as fc


def field(name, value="", calc="", fmt="", obj=0):
    return {"name": name, "value": value, "calc": calc, "format": fmt, "obj": obj}


def test_formulas():
    v = {"qty": "3", "price": "$1,500", "name": "Ada"}
    assert fc.calculate('event.value = this.getField("qty").value * getField("price").value;', v) == 4500
    assert fc.calculate("AFSimple_Calculate('SUM', ['qty', 'price'])", v) == 1503
    assert fc.calculate('AFSimple_Calculate("PRD", new Array("qty", "qty"))', v) == 9
    assert fc.calculate("event.value = 7 / 0 + 2 % 0", v) == 0
    assert fc.calculate('event.value = getField("name").value + 1', v) == "Ada1"
    assert fc.calculate("event.value = -Math.round(2.5) + Math.max(1, (2 + 3) * 2)", v) == 7
    for bad in ("app.alert(1)", "event.value = while", "event.value = eval('1')", "event.value = 1 2"):
        with pytest.raises(fc.Unreadable):
            fc.calculate(bad, v)


def test_recalculation_in_order():
    f = [field("total", calc="AFSimple_Calculate('SUM', ['amount'])", obj=4), field("qty", "3"), field("price", "1500"), field("amount", calc='event.value = getField("qty").value * getField("price").value', fmt="AFNumber_Format(2, 0)", obj=3), field("odd", calc="for(;;){}", obj=9)]
    values, skipped = fc.recalculated(f, [3, 4, 9])
    assert values["amount"] == "4500.00" and values["total"] == "4500" and skipped == ["odd"]
    assert fc.recalculated(f, [])[0]["total"] == "4500"
    f[1]["value"] = "10"
    assert fc.recalculated(f, [3, 4])[0]["amount"] == "15000.00"


def test_formats():
    assert [fc.formatted(x, "AFNumber_Format(2)") for x in (1.005, 2.5, -0.001, 1e6)] == ["1.00", "2.50", "0.00", "1000000.00"]
    assert fc.formatted(0.5, "AFPercent_Format(1)") == "0.5" and fc.formatted(3.0, "") == "3"


def test_form_calc():
    d = {"a": ["1", "2", "x3"], "b": ["10"]}
    assert fc.form_calc("Sum(a[*]) + b * 2", d) == 26 and fc.form_calc("Avg(a[*])", d) == 2
    assert fc.form_calc("Count(a[*]) - Min(a[*], 0)", d) == 3 and fc.form_calc("Max(b, 11)", d) == 11


def test_calculator_functions():
    assert fc.postscript("{ dup mul exch pop }", [2, 3]) == [9] and fc.postscript("{ 2 copy gt { exch } if }", [5, 1]) == [1, 5]
    assert fc.postscript("{ 0.5 lt { 1 } { 0 } ifelse }", [0.3]) == [1] and fc.postscript("{ 3 1 roll }", [1, 2, 3]) == [3, 1, 2]
    assert fc.postscript("{ 7 2 idiv 1 bitshift 1 index add }", [4]) == [4, 10]
    with pytest.raises(fc.Unreadable):
        fc.postscript("{ nosuch }", [])
    assert fc.exponential(0.5, [0, 1], [1, 0], 2) == [0.25, 0.75]
    assert fc.stitched(0.75, (0, 1), [0.5], [0, 1, 1, 0], [lambda t: [t], lambda t: [10 * t]]) == [5]
    assert fc.sampled(0.25, [[0.0], [1.0], [4.0]]) == [0.5]


def test_scripts_where_formulas_end():
    f = [field("n", "4"), field("note", "old"), field("fact", calc='var n = this.getField("n").value, r = 1; for (var i = 2; i <= n; i++) { r = r * i; } if (r > 20) { getField("note").value = "large"; } event.value = r;', fmt="AFNumber_Format(1, 0)", obj=1), field("text", calc='event.value = "n is " + getField("n").value.toString();', obj=2), field("no", "kept", calc="event.value = nosuch.thing;", obj=3)]
    values, skipped = fc.recalculated(f, [1, 2, 3])
    assert (values["fact"], values["note"], values["text"], values["no"]) == ("24.0", "large", "n is 4", "kept") and skipped == ["no"]
    assert fc.recalculated([field("a", "2"), field("s", calc='if (true) AFSimple_Calculate("SUM", ["a", "a"]);', obj=1)], [1])[0]["s"] == "4"
