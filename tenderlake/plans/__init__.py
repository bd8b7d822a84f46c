"""End-to-end jobs: from feeds to published marts, and order tables read as a contract ledger."""
