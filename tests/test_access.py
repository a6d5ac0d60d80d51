import pytest

from stayledger.operators import access
from stayledger.operators.access import PLATFORM_ADMIN, Principal

ADMIN, CHAIN, STAFF = Principal(PLATFORM_ADMIN), Principal("chain_admin", "a"), Principal("hotel_staff", "a", ("h1",))
NOBODY, NO_ROLE, NO_HOTELS = Principal(), Principal(None, "a", ("h1",)), Principal("hotel_staff", "a")


@pytest.fixture(scope="module")
def world(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)
    hotels = table([("h1", "a"), ("h2", "a"), ("h3", "b")], "id string, chain_group_id string")
    return {
        "currencies": table([("NOK",), ("SEK",)], "code string"),
        "chain_groups": table([("a",), ("b",)], "id string"), "hotels": hotels,
        "members": table([(1, "a"), (2, "b")], "id int, chain_group_id string"),
        "member_consents": table([(1, 1), (2, 2), (3, 2)], "id int, member_id int"),
        "bookings": table([(1, "a", "h1"), (2, "a", "h2"), (3, "b", "h3")], "id int, chain_group_id string, hotel_id string"),
        "booking_segments": table([(1, 1), (2, 2), (3, 3)], "id int, booking_id int"),
        "room_stays": table([(1, 1, "h1"), (2, 2, "h2")], "id int, booking_id int, hotel_id string"),
        "admin_users": table([("u1", "a", "chain_admin"), ("u2", "b", "chain_admin"), ("u3", None, PLATFORM_ADMIN)],
                             "id string, chain_group_id string, app_role string"),
        "admin_user_hotel_assignments": table([(1, "u1", "h1"), (2, "u2", "h3")], "id int, admin_user_id string, hotel_id string"),
        "audit_log": table([(1, "a"), (2, None), (3, "b")], "id int, chain_group_id string"),
        "pms_imports": table([(1, "a"), (2, None)], "id int, chain_group_id string"),
        "pms_raw_payloads": table([(1, 1), (2, 2)], "id int, import_id int"),
    }


MATRIX = {
    # table: rows seen by administrator, chain admin, staff of h1, nobody, chain claim without a role, staff without hotels
    "currencies": (2, 2, 2, 2, 2, 2), "chain_groups": (2, 1, 1, 0, 1, 1), "hotels": (3, 2, 1, 0, 1, 0), "members": (2, 1, 1, 0, 1, 1),
    "member_consents": (3, 1, 1, 0, 1, 1), "bookings": (3, 2, 1, 0, 1, 0), "booking_segments": (3, 2, 1, 0, 1, 0),
    "room_stays": (2, 2, 1, 0, 1, 0), "admin_users": (3, 1, 1, 0, 1, 1), "admin_user_hotel_assignments": (2, 1, 1, 0, 1, 1),
    "audit_log": (3, 1, 1, 0, 1, 1), "pms_imports": (2, 1, 1, 0, 1, 1), "pms_raw_payloads": (2, 1, 1, 0, 1, 1),
}


@pytest.mark.parametrize("table", sorted(MATRIX))
def test_matrix(world, table):
    callers = (ADMIN, CHAIN, STAFF, NOBODY, NO_ROLE, NO_HOTELS)
    assert tuple(access.scope_table(table, world, p).count() for p in callers) == MATRIX[table]


def test_own_admin_row_and_editing(world):
    me = Principal("hotel_staff", "a", (), "u2")
    assert {r["id"] for r in access.scope_admin_users(world["admin_users"], me).collect()} == {"u1", "u2"}
    assert access.scope_editable_admin_users(world["admin_users"], me).count() == 0
    assert access.scope_editable_admin_users(world["admin_users"], CHAIN).count() == 1
    assert access.scope_editable_admin_users(world["admin_users"], NO_ROLE).count() == 0


def test_claims():
    p = Principal.from_claims('{"app_role":"hotel_staff","chain_group_id":"7","hotel_ids":["1","2"],"sub":""}', key=int)
    assert p == Principal("hotel_staff", 7, (1, 2), None)
    assert Principal.from_claims("") == Principal() and Principal.from_claims('{"app_role":""}') == Principal()
    with pytest.raises(ValueError):
        Principal.from_claims('{"app_role":"king"}')


def test_every_table_of_the_model_has_an_access_rule(spark):
    from stayledger import schemas
    frames = {t: spark.createDataFrame([], schemas.schema_of(t)) for t in schemas.TABLES}
    assert all(access.scope_table(t, frames, CHAIN).count() == 0 for t in frames)
    with pytest.raises(KeyError):
        access.scope_table("unheard_of", {"unheard_of": frames["members"]}, CHAIN)
