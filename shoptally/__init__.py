"""shoptally: retail analytics and stock-ledger jobs written as Spark DataFrames."""
