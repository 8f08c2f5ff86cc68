"""Status vocabularies the measures compare against.

They are constructor parameters of the measure sets, never literals buried in
an operator, so the same operators run on tables whose codes differ.
"""

from __future__ import annotations

from dataclasses import dataclass


# The status codes the reporting queries test for.
@dataclass(frozen=True)
class BillingStates:
    billed: str = "Facturado"            # estado_contable
    unbilled: str = "Sin Facturar"       # estado_contable
    cancelled: str = "Anulado"           # estado_contable
    with_flt: str = "Con FLT"            # estado_flt
    without_flt: str = "Sin FLT"         # estado_flt
    confirmed: str = "CONFIRMADO"        # estado_flete
    to_confirm: str = "POR CONFIRMAR"    # estado_flete
    collected: str = "COBRADO"           # status_crisar
    accepted: str = "ACEPTADO"           # estado_envio_factura
    reconciled: str = "CONCILIADO"       # estado_conciliacion
    freight_billed: str = "Facturado"    # estado_flete as read from the freight report
    arrived_on_time: str = "Llegó a tiempo"  # estado_viaje


@dataclass(frozen=True)
class TripStates:
    on_time: str = "ON TIME"             # NS / on_time
    off_time: str = "OFF TIME"           # NS / on_time
    plate_sentinels: tuple[str, ...] = ("", "---")  # placa values that mean "no plate"


BILLING = BillingStates()
TRIPS = TripStates()
