"""Feed texts for the tests."""

from __future__ import annotations

from pathlib import Path

HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n'
    '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:b="urn:basic" xmlns:a="urn:aggregate" '
    'xmlns:x="urn:extension" xmlns:at="http://purl.org/atompub/tombstones/1.0">\n<title>Prueba</title>\n'
    '<at:deleted-entry ref="https://feed.test/gone" when="2020-01-01T00:00:00Z"/>\n'
)
TAIL = "\n</feed>\n"


def ids(**schemes: str) -> str:
    return "".join(
        f'<a:PartyIdentification><b:ID schemeName="{k}">{v}</b:ID></a:PartyIdentification>'
        for k, v in schemes.items()
    )


def parents(*names: str | None) -> str:
    inner = ""
    for name in reversed(names):
        label = f"<a:PartyName><b:Name>{name}</b:Name></a:PartyName>" if name is not None else ""
        inner = f"<x:ParentLocatedParty>{label}{inner}</x:ParentLocatedParty>"
    return inner


def lot(
    payable: str | None = None,
    untaxed: str | None = None,
    date: str | None = None,
    winner: str = "",
    code: str | None = None,
) -> str:
    amounts = (f"<b:PayableAmount>{payable}</b:PayableAmount>" if payable is not None else "") + (
        f"<b:TaxExclusiveAmount>{untaxed}</b:TaxExclusiveAmount>" if untaxed is not None else ""
    )
    return (
        "<a:TenderResult>"
        + (f"<b:ResultCode>{code}</b:ResultCode>" if code else "")
        + (f"<b:AwardDate>{date}</b:AwardDate>" if date is not None else "")
        + (f"<a:WinningParty>{winner}</a:WinningParty>" if winner else "")
        + f"<a:AwardedTenderedProject><a:LegalMonetaryTotal>{amounts}</a:LegalMonetaryTotal>"
        + "</a:AwardedTenderedProject></a:TenderResult>"
    )


def folder(
    number: str,
    status: str = "RES",
    buyer_ids: str = "",
    buyer: str = "Concejo de Prueba",
    chain: str = "",
    subject: str = "Obra de prueba",
    total: str = "1210.00",
    untaxed: str = "1000.00",
    lots: str = "",
    nuts: str = "ES120",
    kind: str = "3",
) -> str:
    return (
        f'<x:ContractFolderStatus><b:ContractFolderID>{number}</b:ContractFolderID>'
        f'<x:ContractFolderStatusCode languageID="es">{status}</x:ContractFolderStatusCode>'
        f"<x:LocatedContractingParty><b:ContractingPartyTypeCode>3</b:ContractingPartyTypeCode>"
        f"<a:Party>{buyer_ids}<a:PartyName><b:Name>{buyer}</b:Name></a:PartyName>"
        f"<a:PostalAddress><b:CityName>Oviedo</b:CityName><b:PostalZone>33001</b:PostalZone></a:PostalAddress>"
        f"</a:Party>{chain}</x:LocatedContractingParty>"
        f"<a:ProcurementProject><b:Name>{subject}</b:Name><b:TypeCode>{kind}</b:TypeCode>"
        f'<a:BudgetAmount><b:TotalAmount currencyID="EUR">{total}</b:TotalAmount>'
        f"<b:TaxExclusiveAmount>{untaxed}</b:TaxExclusiveAmount></a:BudgetAmount>"
        "<a:RequiredCommodityClassification><b:ItemClassificationCode>45200000</b:ItemClassificationCode>"
        "</a:RequiredCommodityClassification><a:RequiredCommodityClassification>"
        "<b:ItemClassificationCode>99999999</b:ItemClassificationCode></a:RequiredCommodityClassification>"
        f"<a:RealizedLocation><b:CountrySubentity>Asturias</b:CountrySubentity>"
        f"<b:CountrySubentityCode>{nuts}</b:CountrySubentityCode></a:RealizedLocation>"
        f"</a:ProcurementProject>{lots}</x:ContractFolderStatus>"
    )


def entry(
    key: str, body: str = "", updated: str = "2021-05-04T10:00:00+02:00", summary: str | None = None
) -> str:
    text = f'<summary type="text">{summary}</summary>' if summary is not None else ""
    return (
        f'\n<entry>\n<id>https://feed.test/{key}</id><link href="https://feed.test/ver?id={key}&amp;l=es"/>'
        f"{text}<title>Título {key}</title><updated>{updated}</updated>{body}\n</entry>"
    )


def write(path: Path, *entries: str) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(HEAD + "".join(entries) + TAIL, encoding="utf-8")
    return path
