from tessella.cli import main

main()
