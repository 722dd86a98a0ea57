"""Names of industries by NAICS prefix, as small tables that go to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 2022 subsectors (three digits).
SUBSECTORS = """
111 Crop Production
112 Animal Production and Aquaculture
113 Forestry and Logging
114 Fishing, Hunting and Trapping
115 Support Activities for Agriculture and Forestry
211 Oil and Gas Extraction
212 Mining (except Oil and Gas)
213 Support Activities for Mining
221 Utilities
236 Construction of Buildings
237 Heavy and Civil Engineering Construction
238 Specialty Trade Contractors
311 Food Manufacturing
312 Beverage and Tobacco Product Manufacturing
313 Textile Mills
314 Textile Product Mills
315 Apparel Manufacturing
316 Leather and Allied Product Manufacturing
321 Wood Product Manufacturing
322 Paper Manufacturing
323 Printing and Related Support Activities
324 Petroleum and Coal Products Manufacturing
325 Chemical Manufacturing
326 Plastics and Rubber Products Manufacturing
327 Nonmetallic Mineral Product Manufacturing
331 Primary Metal Manufacturing
332 Fabricated Metal Product Manufacturing
333 Machinery Manufacturing
334 Computer and Electronic Product Manufacturing
335 Electrical Equipment, Appliance, and Component Manufacturing
336 Transportation Equipment Manufacturing
337 Furniture and Related Product Manufacturing
339 Miscellaneous Manufacturing
423 Merchant Wholesalers, Durable Goods
424 Merchant Wholesalers, Nondurable Goods
425 Wholesale Trade Agents and Brokers
441 Motor Vehicle and Parts Dealers
444 Building Material and Garden Equipment and Supplies Dealers
445 Food and Beverage Retailers
449 Furniture, Home Furnishings, Electronics, and Appliance Retailers
455 General Merchandise Retailers
456 Health and Personal Care Retailers
457 Gasoline Stations and Fuel Dealers
458 Clothing, Clothing Accessories, Shoe, and Jewelry Retailers
459 Sporting Goods, Hobby, Musical Instrument, Book, and Miscellaneous Retailers
481 Air Transportation
482 Rail Transportation
483 Water Transportation
484 Truck Transportation
485 Transit and Ground Passenger Transportation
486 Pipeline Transportation
487 Scenic and Sightseeing Transportation
488 Support Activities for Transportation
491 Postal Service
492 Couriers and Messengers
493 Warehousing and Storage
512 Motion Picture and Sound Recording Industries
513 Publishing Industries
516 Broadcasting and Content Providers
517 Telecommunications
518 Computing Infrastructure Providers, Data Processing, Web Hosting, and Related Services
519 Web Search Portals, Libraries, Archives, and Other Information Services
521 Monetary Authorities-Central Bank
522 Credit Intermediation and Related Activities
523 Securities, Commodity Contracts, and Other Financial Investments and Related Activities
524 Insurance Carriers and Related Activities
525 Funds, Trusts, and Other Financial Vehicles
531 Real Estate
532 Rental and Leasing Services
533 Lessors of Nonfinancial Intangible Assets (except Copyrighted Works)
541 Professional, Scientific, and Technical Services
551 Management of Companies and Enterprises
561 Administrative and Support Services
562 Waste Management and Remediation Services
611 Educational Services
621 Ambulatory Health Care Services
622 Hospitals
623 Nursing and Residential Care Facilities
624 Social Assistance
711 Performing Arts, Spectator Sports, and Related Industries
712 Museums, Historical Sites, and Similar Institutions
713 Amusement, Gambling, and Recreation Industries
721 Accommodation
722 Food Services and Drinking Places
811 Repair and Maintenance
812 Personal and Laundry Services
813 Religious, Grantmaking, Civic, Professional, and Similar Organizations
814 Private Households
921 Executive, Legislative, and Other General Government Support
922 Justice, Public Order, and Safety Activities
923 Administration of Human Resource Programs
924 Administration of Environmental Quality Programs
925 Administration of Housing Programs, Urban Planning, and Community Development
926 Administration of Economic Programs
927 Space Research and Technology
928 National Security and International Affairs
"""

# The sectors (two digits).
SECTORS = """
11 Agriculture, forestry, fishing and hunting
21 Mining, quarrying, and oil and gas extraction
22 Utilities
23 Construction
31 Manufacturing (31)
32 Manufacturing (32)
33 Manufacturing (33)
42 Wholesale trade
44 Retail trade (44)
45 Retail trade (45)
48 Transportation and warehousing (48)
49 Transportation and warehousing (49)
51 Information
52 Finance and insurance
53 Real estate and rental and leasing
54 Professional, scientific, and technical services
55 Management of companies and enterprises
56 Administrative and support and waste management
61 Educational services
62 Health care and social assistance
71 Arts, entertainment, and recreation
72 Accommodation and food services
81 Other services (except public administration)
92 Public administration
99 Code 99 (not a NAICS sector)
"""


def titles(text: str = SUBSECTORS) -> dict[str, str]:
    return dict(line.split(" ", 1) for line in text.strip().splitlines())


def title(code: object) -> str | None:
    """The subsector's name; codes that were read as decimals lose their `.0`, unknown ones have none."""
    return None if code is None else titles().get(str(code).strip().removesuffix(".0"))


def title_column(code: Column, text: str = SUBSECTORS) -> Column:
    """The same as an expression; `text`: whose titles."""
    pairs = [F.lit(x) for kv in titles(text).items() for x in kv]
    return F.create_map(*pairs)[F.regexp_replace(F.trim(code.cast("string")), r"\.0$", "")]


def title_table(spark: SparkSession, text: str = SUBSECTORS) -> DataFrame:
    """code, title, for joins."""
    return spark.createDataFrame([*titles(text).items()], "code string, title string")
